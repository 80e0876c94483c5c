"""Time zones by their many names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows names of zones that calendars carry, and their IANA names.
WINDOWS = {
    "Dateline Standard Time": "Etc/GMT+12", "UTC-11": "Etc/GMT+11", "Aleutian Standard Time": "America/Adak", "Hawaiian Standard Time": "Pacific/Honolulu", "Marquesas Standard Time": "Pacific/Marquesas",
    "Alaskan Standard Time": "America/Anchorage", "UTC-09": "Etc/GMT+9", "Pacific Standard Time (Mexico)": "America/Tijuana", "UTC-08": "Etc/GMT+8", "Pacific Standard Time": "America/Los_Angeles",
    "US Mountain Standard Time": "America/Phoenix", "Mountain Standard Time (Mexico)": "America/Mazatlan", "Mountain Standard Time": "America/Denver", "Yukon Standard Time": "America/Whitehorse",
    "Central America Standard Time": "America/Guatemala", "Central Standard Time": "America/Chicago", "Easter Island Standard Time": "Pacific/Easter", "Central Standard Time (Mexico)": "America/Mexico_City",
    "Canada Central Standard Time": "America/Regina", "SA Pacific Standard Time": "America/Bogota", "Eastern Standard Time (Mexico)": "America/Cancun", "Eastern Standard Time": "America/New_York",
    "Haiti Standard Time": "America/Port-au-Prince", "Cuba Standard Time": "America/Havana", "US Eastern Standard Time": "America/Indiana/Indianapolis", "Turks And Caicos Standard Time": "America/Grand_Turk",
    "Paraguay Standard Time": "America/Asuncion", "Atlantic Standard Time": "America/Halifax", "Venezuela Standard Time": "America/Caracas", "Central Brazilian Standard Time": "America/Cuiaba", "SA Western Standard Time": "America/La_Paz",
    "Pacific SA Standard Time": "America/Santiago", "Newfoundland Standard Time": "America/St_Johns", "Tocantins Standard Time": "America/Araguaina", "E. South America Standard Time": "America/Sao_Paulo",
    "SA Eastern Standard Time": "America/Cayenne", "Argentina Standard Time": "America/Argentina/Buenos_Aires", "Greenland Standard Time": "America/Nuuk", "Montevideo Standard Time": "America/Montevideo",
    "Magallanes Standard Time": "America/Punta_Arenas", "Saint Pierre Standard Time": "America/Miquelon", "Bahia Standard Time": "America/Bahia", "UTC-02": "Etc/GMT+2", "Mid-Atlantic Standard Time": "Etc/GMT+2",
    "Azores Standard Time": "Atlantic/Azores", "Cape Verde Standard Time": "Atlantic/Cape_Verde", "UTC": "Etc/UTC", "GMT Standard Time": "Europe/London", "Greenwich Standard Time": "Atlantic/Reykjavik",
    "Sao Tome Standard Time": "Africa/Sao_Tome", "Morocco Standard Time": "Africa/Casablanca", "W. Europe Standard Time": "Europe/Berlin", "Central Europe Standard Time": "Europe/Budapest", "Romance Standard Time": "Europe/Paris",
    "Central European Standard Time": "Europe/Warsaw", "W. Central Africa Standard Time": "Africa/Lagos", "Jordan Standard Time": "Asia/Amman", "GTB Standard Time": "Europe/Bucharest", "Middle East Standard Time": "Asia/Beirut",
    "Egypt Standard Time": "Africa/Cairo", "E. Europe Standard Time": "Europe/Chisinau", "Syria Standard Time": "Asia/Damascus", "West Bank Standard Time": "Asia/Hebron", "South Africa Standard Time": "Africa/Johannesburg",
    "FLE Standard Time": "Europe/Kiev", "Israel Standard Time": "Asia/Jerusalem", "South Sudan Standard Time": "Africa/Juba", "Kaliningrad Standard Time": "Europe/Kaliningrad", "Sudan Standard Time": "Africa/Khartoum",
    "Libya Standard Time": "Africa/Tripoli", "Namibia Standard Time": "Africa/Windhoek", "Arabic Standard Time": "Asia/Baghdad", "Turkey Standard Time": "Europe/Istanbul", "Arab Standard Time": "Asia/Riyadh",
    "Belarus Standard Time": "Europe/Minsk", "Russian Standard Time": "Europe/Moscow", "E. Africa Standard Time": "Africa/Nairobi", "Volgograd Standard Time": "Europe/Volgograd", "Iran Standard Time": "Asia/Tehran",
    "Arabian Standard Time": "Asia/Dubai", "Astrakhan Standard Time": "Europe/Astrakhan", "Azerbaijan Standard Time": "Asia/Baku", "Russia Time Zone 3": "Europe/Samara", "Mauritius Standard Time": "Indian/Mauritius",
    "Saratov Standard Time": "Europe/Saratov", "Georgian Standard Time": "Asia/Tbilisi", "Caucasus Standard Time": "Asia/Yerevan", "Afghanistan Standard Time": "Asia/Kabul", "West Asia Standard Time": "Asia/Tashkent",
    "Ekaterinburg Standard Time": "Asia/Yekaterinburg", "Pakistan Standard Time": "Asia/Karachi", "Qyzylorda Standard Time": "Asia/Qyzylorda", "India Standard Time": "Asia/Kolkata", "Sri Lanka Standard Time": "Asia/Colombo",
    "Nepal Standard Time": "Asia/Kathmandu", "Central Asia Standard Time": "Asia/Bishkek", "Bangladesh Standard Time": "Asia/Dhaka", "Omsk Standard Time": "Asia/Omsk", "Myanmar Standard Time": "Asia/Yangon",
    "SE Asia Standard Time": "Asia/Bangkok", "Altai Standard Time": "Asia/Barnaul", "W. Mongolia Standard Time": "Asia/Hovd", "North Asia Standard Time": "Asia/Krasnoyarsk", "N. Central Asia Standard Time": "Asia/Novosibirsk",
    "Tomsk Standard Time": "Asia/Tomsk", "China Standard Time": "Asia/Shanghai", "North Asia East Standard Time": "Asia/Irkutsk", "Singapore Standard Time": "Asia/Singapore", "W. Australia Standard Time": "Australia/Perth",
    "Taipei Standard Time": "Asia/Taipei", "Ulaanbaatar Standard Time": "Asia/Ulaanbaatar", "Aus Central W. Standard Time": "Australia/Eucla", "Transbaikal Standard Time": "Asia/Chita", "Tokyo Standard Time": "Asia/Tokyo",
    "North Korea Standard Time": "Asia/Pyongyang", "Korea Standard Time": "Asia/Seoul", "Yakutsk Standard Time": "Asia/Yakutsk", "Cen. Australia Standard Time": "Australia/Adelaide", "AUS Central Standard Time": "Australia/Darwin",
    "E. Australia Standard Time": "Australia/Brisbane", "AUS Eastern Standard Time": "Australia/Sydney", "West Pacific Standard Time": "Pacific/Port_Moresby", "Tasmania Standard Time": "Australia/Hobart",
    "Vladivostok Standard Time": "Asia/Vladivostok", "Lord Howe Standard Time": "Australia/Lord_Howe", "Bougainville Standard Time": "Pacific/Bougainville", "Russia Time Zone 10": "Asia/Srednekolymsk",
    "Magadan Standard Time": "Asia/Magadan", "Norfolk Standard Time": "Pacific/Norfolk", "Sakhalin Standard Time": "Asia/Sakhalin", "Central Pacific Standard Time": "Pacific/Guadalcanal", "Russia Time Zone 11": "Asia/Kamchatka",
    "New Zealand Standard Time": "Pacific/Auckland", "UTC+12": "Etc/GMT-12", "Fiji Standard Time": "Pacific/Fiji", "Chatham Islands Standard Time": "Pacific/Chatham", "UTC+13": "Etc/GMT-13", "Tonga Standard Time": "Pacific/Tongatapu",
    "Samoa Standard Time": "Pacific/Apia", "Line Islands Standard Time": "Pacific/Kiritimati",
}
#: Names that mail programs show for zones.
SHOWN = {
    "(UTC) Coordinated Universal Time": "Etc/UTC", "(UTC+00:00) Dublin, Edinburgh, Lisbon, London": "Europe/London", "(UTC+00:00) Dublin, Edinburgh, Lissabon, London": "Europe/London",
    "(UTC+01:00) Amsterdam, Berlin, Bern, Rome, Stockholm, Vienna": "Europe/Berlin", "(UTC+01:00) Amsterdam, Berlin, Bern, Rom, Stockholm, Wien": "Europe/Berlin",
    "(UTC+01:00) Belgrade, Bratislava, Budapest, Ljubljana, Prague": "Europe/Budapest", "(UTC+01:00) Belgrad, Bratislava (Pressburg), Budapest, Ljubljana, Prag (Praha)": "Europe/Budapest",
    "(UTC+01:00) Brussels, Copenhagen, Madrid, Paris": "Europe/Paris", "(UTC+01:00) Brüssel, Kopenhagen, Madrid, Paris": "Europe/Paris", "(UTC+01:00) Sarajevo, Skopje, Warsaw, Zagreb": "Europe/Warsaw",
    "(UTC+01:00) Sarajevo, Skopje, Warschau, Zagreb": "Europe/Warsaw", "(UTC+02:00) Athens, Bucharest": "Europe/Bucharest", "(UTC+02:00) Athen, Bukarest": "Europe/Bucharest",
    "(UTC+02:00) Helsinki, Kyiv, Riga, Sofia, Tallinn, Vilnius": "Europe/Kiev", "(UTC+02:00) Helsinki, Kiew, Riga, Sofia, Tallinn, Wilna": "Europe/Kiev", "(UTC+03:00) Istanbul": "Europe/Istanbul",
    "(UTC+03:00) Moscow, St. Petersburg": "Europe/Moscow", "(UTC+04:00) Abu Dhabi, Muscat": "Asia/Dubai", "(UTC+05:30) Chennai, Kolkata, Mumbai, New Delhi": "Asia/Kolkata",
    "(UTC+08:00) Beijing, Chongqing, Hong Kong, Urumqi": "Asia/Shanghai", "(UTC+09:00) Osaka, Sapporo, Tokyo": "Asia/Tokyo", "(UTC+10:00) Canberra, Melbourne, Sydney": "Australia/Sydney",
    "(UTC-05:00) Eastern Time (US & Canada)": "America/New_York", "(UTC-06:00) Central Time (US & Canada)": "America/Chicago", "(UTC-07:00) Mountain Time (US & Canada)": "America/Denver",
    "(UTC-08:00) Pacific Time (US & Canada)": "America/Los_Angeles",
}
_iana = r"^(?:[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+){1,2}|UTC|GMT|CET|EET|WET)$"


def zone_name(written: Column, offset: Column | None = None, fallback: str | None = "UTC") -> Column:
    """The zone that a calendar's name stands for: an IANA name, also behind a vendor's prefix; a Windows name or a shown one, in any
    case; a fixed offset; else `fallback`, or null.

    offset: the standard offset that the calendar itself defines for the name, such as +0100.
    """
    bare = F.trim(F.regexp_replace(written, r'^"|"$', ""))
    inner = F.regexp_extract(bare, r"(?:^|/)((?:Africa|America|Antarctica|Asia|Atlantic|Australia|Etc|Europe|Indian|Pacific)/[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)?)$", 1)
    windows = F.try_element_at(F.str_to_map(F.lit("\n".join(f"{k.lower()}={v}" for k, v in (WINDOWS | SHOWN).items())), F.lit("\n"), F.lit("=")), F.lower(bare))
    fixed = lambda c: F.when(c.rlike(r"^(?:UTC|GMT)?[+-]\d{2}:?\d{2}$"), F.regexp_replace(c, r"^(?:UTC|GMT)?([+-]\d{2}):?(\d{2})$", "$1:$2"))
    known = F.coalesce(F.nullif(inner, F.lit("")), windows, F.when(bare.rlike(_iana), bare), fixed(bare))
    return F.coalesce(known, *([fixed(offset)] if offset is not None else []), F.lit(fallback).cast("string"))
