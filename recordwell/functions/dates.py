"""Date buckets, series and moments as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context

GRAINS = "DAY WEEK MONTH QUARTER YEAR DAY_OF_WEEK MONTH_OF_YEAR QUARTER_OF_YEAR".split()


def bucket(day: Column, grain: str) -> Column:
    """The bucket of a day as text; weeks are ISO weeks."""
    grain = grain.upper()
    quarter = F.concat(F.lit("Q"), F.quarter(day).cast("string"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    made = {
        "DAY": lambda: F.date_format(day, "yyyy-MM-dd"),
        "WEEK": lambda: F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), two(F.weekofyear(day))),
        "MONTH": lambda: F.date_format(day, "yyyy-MM"),
        "QUARTER": lambda: F.concat(F.year(day).cast("string"), F.lit("-"), quarter),
        "YEAR": lambda: F.year(day).cast("string"),
        "DAY_OF_WEEK": lambda: (F.weekday(day) + 1).cast("string"),
        "MONTH_OF_YEAR": lambda: two(F.month(day)),
        "QUARTER_OF_YEAR": lambda: quarter,
    }
    if grain not in made:
        raise ValueError(f"unknown granularity {grain}")
    return made[grain]()


#: What labels of buckets need, by language.
LABELS = {
    "en": {"week": ("Week ", " "), "months": "January February March April May June July August September October November December".split(), "weekdays": "Mon Tue Wed Thu Fri Sat Sun".split()},
    "de": {"week": ("KW ", " "), "months": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(), "weekdays": "Mo Di Mi Do Fr Sa So".split()},
}


def bucket_label(key: Column, grain: str, language: str = "en", day_pattern: str = "dd.MM.yyyy") -> Column:
    """A bucket's key for people; keys that don't look like the grain's stay as they are."""
    grain, t = grain.upper(), LABELS[language]
    name = lambda names, k: F.get(F.array(*map(F.lit, names)), k.try_cast("int") - 1)
    before, between = t["week"]
    made = {
        "DAY": lambda: F.date_format(key.try_cast("date"), day_pattern),
        "WEEK": lambda: F.when(key.rlike(r"^\d+-W\d+$"), F.concat(F.lit(before), F.substring_index(key, "-W", -1).cast("int").cast("string"), F.lit(between), F.substring_index(key, "-W", 1))),
        "MONTH": lambda: F.when(key.rlike(r"^\d+-\d+$"), F.concat(name([m[:3] for m in t["months"]], F.substring_index(key, "-", -1)), F.lit(" "), F.substring_index(key, "-", 1))),
        "QUARTER": lambda: F.when(key.rlike(r"^\d+-Q\d$"), F.concat(F.substring_index(key, "-", -1), F.lit(" "), F.substring_index(key, "-", 1))),
        "DAY_OF_WEEK": lambda: name(t["weekdays"], key),
        "MONTH_OF_YEAR": lambda: name(t["months"], key),
    }
    return F.coalesce(made[grain](), key) if grain in made else key


def gap_filled(groups: DataFrame, day: str, grain: str, values: dict[str, object]) -> DataFrame:
    """A row for each bucket between the first and the last day of `groups` (a row a bucket, its first day in `day`); values: what fills gaps."""
    step = {"DAY": "interval 1 day", "WEEK": "interval 7 days", "MONTH": "interval 1 month", "QUARTER": "interval 3 months", "YEAR": "interval 1 year"}[grain.upper()]
    span = groups.agg(F.min(day).alias("a"), F.max(day).alias("z"))
    series = span.where("a is not null").select(F.explode(F.sequence("a", "z", F.expr(step))).alias(day)).select(F.col(day).cast("date").alias(day))
    joined = series.join(groups, day, "left")
    return joined.select(day, *(F.coalesce(F.col(k), F.lit(v).cast(groups.schema[k].dataType)).alias(k) for k, v in values.items()))


def parse_instant(text: Column) -> Column:
    """ISO instants with fraction and offset; without an offset they are in the session's zone. Microseconds are kept. Null if it is none."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(ok, text.try_cast("timestamp"))


_clock = r"(?:[ ,T]+\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:Uhr|[AaPp][Mm]))?)?"


def parse_day(text: Column, slash_order: str | None = None) -> Column:
    """A struct (day, rule): ISO, day.month.year, year.month.day, and dates with slashes or dashes in the declared order (DMY or MDY).

    Without a declared order such a date counts if one reading only is a date, or both are the same. Two-digit years from 30 on
    are of the last century; a time of day may follow. rule is date or ambiguous-date where no day is found.
    """
    order = (slash_order or "").upper()
    trimmed = F.trim(text)
    long_year = F.regexp_replace(trimmed, rf"^(\d{{1,2}}\.\s?\d{{1,2}}\.\s?|\d{{1,2}}[/-]\d{{1,2}}[/-])([0-2]\d)({_clock})$", "$120$2$3")
    t = F.regexp_replace(long_year, rf"^(\d{{1,2}}\.\s?\d{{1,2}}\.\s?|\d{{1,2}}[/-]\d{{1,2}}[/-])([3-9]\d)({_clock})$", "$119$2$3")
    over_twelve = r"1[3-9]|[2-9]\d"
    slashed = rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}){_clock}$"
    shapes = [(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$", "$1-$2-$3"), (rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}){_clock}$", "$3-$2-$1"), (r"^(\d{4})[./](\d{1,2})[./](\d{1,2})$", "$1-$2-$3")]
    if order in ("DMY", "MDY"):
        shapes.append((slashed, "$3-$2-$1" if order == "DMY" else "$3-$1-$2"))
    else:
        shapes += [(slashed.replace(r"^(\d{1,2})", f"^({over_twelve})", 1), "$3-$2-$1"), (slashed.replace(r"](\d{1,2})", f"]({over_twelve})", 1), "$3-$1-$2"), (rf"^0?(\d{{1,2}})[/-]0?(\1)[/-](\d{{4}}){_clock}$", "$3-$2-$1")]
    plain = F.when(t.rlike(shapes[0][0]), F.regexp_replace(t, *shapes[0]))
    for shape in shapes[1:]:
        plain = plain.when(t.rlike(shape[0]), F.regexp_replace(t, *shape))
    day = plain.try_cast("date")
    rule = F.when(day.isNotNull() | t.isNull() | (t == ""), F.lit(None)).when(plain.isNull() & t.rlike(slashed), "ambiguous-date").otherwise("date")
    return F.struct(day.alias("day"), rule.alias("rule"))


def to_instant(local: Column, context: Context) -> Column:
    """The instant of a wall clock time in the zone; the first of two."""
    return F.to_utc_timestamp(local, context.zone_name)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole seconds as days, two places, half up."""
    seconds = F.unix_seconds(later) - F.unix_seconds(earlier)
    return days_of(seconds)


def days_of(seconds: Column) -> Column:
    return F.round(seconds.cast("decimal(20,0)") / F.lit(86400).cast("decimal(5,0)"), 2).cast("decimal(18,2)")
