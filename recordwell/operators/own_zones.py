"""Time zones that a calendar defines itself: rules become a table of transitions, and wall clock times find theirs among those of their zone.

A VTIMEZONE holds observances: from when on which offset holds, by a rule or a list. Each onset is an instant, its wall clock less the
offset before it; between two onsets one offset holds. A wall clock time that comes twice is the first of the two; one that
is skipped is read with the offset before the gap. Before its first onset a zone has the offset from which its earliest observance
leaves. A zone of one offset has that one throughout.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import kept
from ..functions.recurrence import row_rule_days
from ..sources.mail import ZONE_LINES, unfolded

#: Onsets, and stretches of one offset, up to which they are broadcast, whatever the number of definitions.
BROADCAST_ONSETS, BROADCAST_STRETCHES = 500_000, 50_000


def _sized(rows: DataFrame, length: Column, most: int) -> DataFrame:
    """rows, marked for a broadcast where their arrays hold so many values at most, else for a merge."""
    held = rows.agg(F.sum(F.greatest(length, F.lit(1)).cast("long"))).first()[0] or 0
    return F.broadcast(rows) if held <= most else rows.hint("merge")


def _seconds(offset: Column) -> Column:
    """Of an offset such as +0130 or -023015."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(offset, r"^[+-](\d\d)(\d\d)(\d\d)?$", k), F.lit("")).cast("int"), F.lit(0))
    return F.when(offset.rlike(r"^[+-]\d{4}(?:\d\d)?$"), F.when(offset.startswith("-"), -1).otherwise(1) * (part(1) * 3600 + part(2) * 60 + part(3)))


def zone_blocks(text: Column) -> Column:
    """The definitions of zones in an iCalendar text, as an array."""
    return F.regexp_extract_all(unfolded(text), F.lit(ZONE_LINES), F.lit(1))


def definition(blocks: Column) -> Column:
    """A key of what zone_blocks gives, so that calendars that define the same share their transitions; none of them holds the mark between."""
    return F.sha2(F.array_join(blocks, "END:VTIMEZONE"), 256)


def observances(df: DataFrame, text: str | None = "text", blocks: str = "blocks") -> DataFrame:
    """(all other columns, zone, starts, offset_from, offset_to, rule, added): a row an observance of the zones that iCalendar texts define.

    Those without a start or an offset that can be read are left out. Without text, blocks has what zone_blocks gives.
    """
    kept = [c for c in df.columns if c != (text or blocks)]
    blocks = df.select(*kept, F.explode(zone_blocks(F.col(text)) if text else F.col(blocks)).alias("z"))
    parts = blocks.select(*kept, F.trim(F.regexp_extract("z", r"(?m)^TZID:(.*?)\r?$", 1)).alias("zone"), F.explode(F.regexp_extract_all(F.col("z"), F.lit(r"(?s)BEGIN:(STANDARD|DAYLIGHT)\r?\n(.*?)END:\1"), F.lit(2))).alias("o"))
    line = lambda name: F.nullif(F.regexp_extract("o", rf"(?m)^{name}(?:;[^:\n]*)?:(.*?)\r?$", 1), F.lit(""))
    moment = lambda v: F.try_to_timestamp(F.regexp_replace(F.when(F.length(v) == 8, F.concat(v, F.lit("T000000"))).otherwise(v), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    added = F.transform(F.flatten(F.transform(F.regexp_extract_all(F.col("o"), F.lit(r"(?m)^RDATE(?:;[^:\n]*)?:(.*?)\r?$"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*"))), moment)
    out = parts.select(*kept, "zone", moment(line("DTSTART")).alias("starts"), _seconds(line("TZOFFSETFROM")).alias("offset_from"), _seconds(line("TZOFFSETTO")).alias("offset_to"), line("RRULE").alias("rule"), F.filter(added, lambda x: x.isNotNull()).alias("added"))
    return out.where("zone <> '' and starts is not null and offset_from is not null and offset_to is not null")


def transitions(found: DataFrame, keys: list[str], first_year: int, last_year: int) -> DataFrame:
    """(keys, zone, since, until, offset): from when to when (UTC, null for ever) which offset holds, for wall clocks of these years.

    Rules that name their months don't depend on their start, so they are expanded from shortly before the first year only. Calendars share
    their definitions, so each different one is expanded once, and met by those that hold it.
    """
    whole_rows = found
    terms = ["starts", "rule", "added"]
    found = found.select(*terms).distinct()
    early, late = F.make_date(F.lit(first_year - 2), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year + 2), F.lit(12), F.lit(31))
    start = F.to_date("starts")
    steady = F.col("rule").rlike(r"BYMONTH=(?:[2-9]|1[0-2])(?:;|$)") & F.col("rule").contains("BYDAY=") & ~F.col("rule").rlike("COUNT=|INTERVAL=")
    shifted = steady & (start < early)
    from_day = F.when(shifted, early).otherwise(start)
    days = F.when(F.col("rule").isNull(), F.array(start)).otherwise(F.coalesce(row_rule_days(F.col("rule"), from_day, late), F.array(start)))
    days = F.when(shifted, F.array_except(days, F.array(early))).otherwise(days)
    clock = F.date_format("starts", "HH:mm:ss")
    onsets = F.array_union(F.transform(days, lambda d: F.concat(d.cast("string"), F.lit(" "), clock).cast("timestamp_ntz")), F.col("added"))
    # A rule that ended before the years still says which offset came last.
    spans = kept(found.select(*terms, onsets.alias("onsets")), "onsets").select(*(F.col(c).alias(f"d_{c}") for c in terms), F.when(F.size("onsets") == 0, F.array("starts")).otherwise(F.col("onsets")).alias("onsets"))
    spans = _sized(spans, F.size("onsets"), BROADCAST_ONSETS)
    found = whole_rows.join(spans, reduce(and_, (F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in terms)))
    earliest = F.min_by(F.struct("offset_from", "starts"), F.struct("starts", "offset_from"))
    zones = found.groupBy(*keys, "zone").agg(earliest.alias("e"), F.countDistinct("offset_to").alias("n"), F.min("offset_to").alias("only"))
    each = found.select(*keys, "zone", F.explode("onsets").alias("onset"), "offset_from", F.col("offset_to").alias("offset"))
    each = each.select(*keys, "zone", F.unix_seconds(F.col("onset").cast("timestamp")).alias("t"), "offset_from", "offset").select(*keys, "zone", (F.col("t") - F.col("offset_from")).alias("since"), "offset")
    before = zones.select(*keys, "zone", F.lit(None).cast("long").alias("since"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("e.offset_from")).alias("offset"))
    # Of two observances with one onset the later row would be empty; the greater offset stands.
    whole = each.groupBy(*keys, "zone", "since").agg(F.max("offset").alias("offset")).unionByName(before)
    w = Window.partitionBy(*keys, "zone").orderBy(F.col("since").asc_nulls_first())
    return whole.withColumn("until", F.lead("since").over(w)).select(*keys, "zone", "since", "until", "offset")


def met(rows: DataFrame, keys: list[str], zone: str, table: DataFrame, name: str = "stretches") -> DataFrame:
    """rows with a struct of their zone's transitions (stretches in order, least and widest offset), for instant; null where the calendar doesn't define the zone.

    The bytes of a table's files say little of its rows, so few stretches are broadcast after they were counted, and many meet by a merge, never by a guess.
    """
    stretches = F.array_sort(F.collect_list(F.struct("since", "until", "offset")))
    zones = kept(table.groupBy(*keys, "zone").agg(F.struct(stretches.alias("each"), F.min("offset").alias("least"), F.max("offset").alias("widest")).alias(name)), "zones")
    zones = _sized(zones.select(*(F.col(k).alias(f"f_{k}") for k in keys), F.col("zone").alias("f_zone"), name), F.size(f"{name}.each"), BROADCAST_STRETCHES)
    return rows.join(zones, [F.col(k) == F.col(f"f_{k}") for k in keys] + [F.col(zone) == F.col("f_zone")], "left").drop("f_zone", *(f"f_{k}" for k in keys))


def near(stretches: Column, first: Column, last: Column) -> Column:
    """Of a struct that met gives what wall clock times between two can fall into."""
    t = lambda c: F.unix_seconds(c.cast("timestamp"))
    touches = lambda s: (s.until.isNull() | (s.until > t(first) - stretches.widest)) & (s.since.isNull() | (s.since <= t(last) - stretches.least))
    return F.when(stretches.isNotNull(), F.struct(F.filter(stretches.each, touches).alias("each"), stretches.least.alias("least"), stretches.widest.alias("widest")))


def instant(local: Column, stretches: Column) -> Column:
    """The instant (timestamp_ntz in UTC) of a wall clock time, by the struct that met gives."""
    t = F.unix_seconds(local.cast("timestamp"))
    within = lambda s, u: (s.since.isNull() | (s.since <= u)) & (s.until.isNull() | (u < s.until))
    greatest = lambda holds: F.aggregate(stretches.each, F.lit(None).cast("int"), lambda most, s: F.when(holds(s), F.greatest(most, s.offset)).otherwise(most))
    offset = F.coalesce(greatest(lambda s: within(s, t - s.offset)), greatest(lambda s: within(s, t - stretches.widest)))
    return F.timestamp_seconds(t - offset).cast("timestamp_ntz")


def to_utc(rows: DataFrame, keys: list[str], zone: str, local: str, table: DataFrame, name: str = "utc") -> DataFrame:
    """rows with the instant (timestamp_ntz in UTC) of a wall clock time in a zone of their calendar; null where the calendar doesn't define the zone."""
    return met(rows, keys, zone, table, "z_stretches").withColumn(name, instant(F.col(local), F.col("z_stretches"))).drop("z_stretches")
