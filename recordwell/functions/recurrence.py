"""Recurring events and cron patterns, expanded within the row by higher-order functions: no Python, no join.

A rule's days are a day series from the start to a bound, filtered by the rule's parts.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day names in ISO order.
DAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
PARTS = {"FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "WKST"}


class RuleError(ValueError):
    """A rule or pattern can't be expanded."""


def parsed_rule(text: str) -> dict[str, str]:
    """A rule's parts; parts that this expansion doesn't know are refused."""
    parts = dict(p.upper().split("=", 1) for p in text.removeprefix("RRULE:").strip(";").split(";") if "=" in p)
    if unknown := set(parts) - PARTS:
        raise RuleError(f"can't expand {', '.join(sorted(unknown))}")
    if parts.get("FREQ") not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY"):
        raise RuleError(f"can't expand FREQ={parts.get('FREQ')}")
    return parts


def rule_days(rule: str, start: Column, last: Column) -> Column:
    """The array of days from `start` to `last` (dates) on which the rule occurs, in order; COUNT counts from the start."""
    p = parsed_rule(rule)
    every = int(p.get("INTERVAL", 1))
    if every < 1:
        raise RuleError("INTERVAL is at least 1")
    if until := p.get("UNTIL"):
        last = F.least(last, F.lit(f"{until[:4]}-{until[4:6]}-{until[6:8]}").cast("date"))
    ordinals = [re.fullmatch(r"([+-]?\d+)?(MO|TU|WE|TH|FR|SA|SU)", d) for d in p.get("BYDAY", "").split(",") if d]
    if None in ordinals:
        raise RuleError(f"can't expand BYDAY={p['BYDAY']}")
    by_day = [(int(m[1] or 0), DAYS.index(m[2])) for m in ordinals]
    month_days = [int(x) for x in p.get("BYMONTHDAY", "").split(",") if x]
    months = [int(x) for x in p.get("BYMONTH", "").split(",") if x]
    week_start = DAYS.index(p.get("WKST", "MO"))
    freq = p["FREQ"]

    def holds(d: Column) -> Column:
        tests = []
        if months:
            tests.append(F.month(d).isin(months))
        month_no = lambda x: F.year(x) * 12 + F.month(x)
        first_of_week = lambda x: F.date_sub(x, F.pmod(F.weekday(x) - week_start, F.lit(7)))
        if freq == "DAILY":
            tests.append(F.datediff(d, start) % every == 0)
        elif freq == "WEEKLY":
            tests.append((F.datediff(first_of_week(d), first_of_week(start)) / 7).cast("int") % every == 0)
        elif freq == "MONTHLY":
            tests.append((month_no(d) - month_no(start)) % every == 0)
        else:
            tests.append((F.year(d) - F.year(start)) % every == 0)
        if month_days:
            from_end = F.datediff(d, F.last_day(d)) - 1
            tests.append(F.dayofmonth(d).isin(month_days) | from_end.isin(month_days))
        if by_day:
            tests.append(reduce(or_, (_nth(d, n, w, freq, bool(months)) for n, w in by_day)))
        if not month_days and not by_day:
            if freq == "WEEKLY":
                tests.append(F.weekday(d) == F.weekday(start))
            elif freq in ("MONTHLY", "YEARLY"):
                tests.append(F.dayofmonth(d) == F.dayofmonth(start))
                if freq == "YEARLY" and not months:
                    tests.append(F.month(d) == F.month(start))
        return reduce(and_, tests)

    series = F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<date>"))
    days = F.filter(series, holds)
    # The start itself always occurs, also where the rule doesn't meet it.
    days = F.array_sort(F.array_union(F.when(last >= start, F.array(start)).otherwise(F.array().cast("array<date>")), days))
    return F.slice(days, 1, int(p["COUNT"])) if "COUNT" in p else days


def _nth(d: Column, n: int, weekday: int, freq: str, in_month: bool) -> Column:
    same = F.weekday(d) == weekday
    if n == 0 or freq in ("DAILY", "WEEKLY"):
        return same
    if freq == "YEARLY" and not in_month:
        place = F.floor((F.dayofyear(d) - 1) / 7) + 1 if n > 0 else -(F.floor(F.datediff(F.make_date(F.year(d), F.lit(12), F.lit(31)), d) / 7) + 1)
    else:
        place = F.floor((F.dayofmonth(d) - 1) / 7) + 1 if n > 0 else -(F.floor(F.datediff(F.last_day(d), d) / 7) + 1)
    return same & (place == n)


def occurrences(rule: str, local_start: Column, zone: Column | str, last: Column, excluded: Column | None = None, added: Column | None = None) -> Column:
    """The instants of a recurring event whose wall clock start stands in its own zone; excluded and added are arrays of wall clock times."""
    time = F.date_format(local_start, "HH:mm:ss")
    local = F.transform(rule_days(rule, F.to_date(local_start), last), lambda d: F.concat(d.cast("string"), F.lit(" "), time).cast("timestamp_ntz"))
    if added is not None:
        local = F.array_union(local, added)
    if excluded is not None:
        local = F.array_except(local, excluded)
    z = F.lit(zone) if isinstance(zone, str) else zone
    return F.array_sort(F.transform(local, lambda t: F.to_utc_timestamp(t.cast("timestamp"), z)))


def cron_sets(pattern: str) -> list[list[int]]:
    """Minutes, hours, days of the month, months and weekdays (0 is Sunday) of a five-part pattern."""
    fields = pattern.split()
    if len(fields) != 5:
        raise RuleError("a pattern has five parts")
    names = [{}, {}, {}, {n: k for k, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}, {n: k for k, n in enumerate("sun mon tue wed thu fri sat".split())}]
    out = []
    for field, (low, high), known in zip(fields, [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)], names, strict=True):
        number = lambda x, known=known: known.get(x.lower(), int(x) if x.isdigit() else -1)
        found: set[int] = set()
        for part in field.split(","):
            m = re.fullmatch(r"(\*|\w+)(?:-(\w+))?(?:/(\d+))?", part)
            if not m or m[3] == "0":
                raise RuleError(f"not a pattern: {part}")
            a, z = (low, high) if m[1] == "*" else (number(m[1]), number(m[2]) if m[2] else (high if m[3] else number(m[1])))
            if not low <= a <= z <= high:
                raise RuleError(f"not a pattern: {part}")
            found |= set(range(a, z + 1, int(m[3] or 1)))
        out.append(sorted({x % 7 for x in found} if high == 7 else found))
    return out


def cron_slots(pattern: str, after: Column, until: Column) -> Column:
    """The array of instants (UTC) after `after` and up to `until` that a pattern names. If both day parts are set, either may hold."""
    minutes, hours, month_days, months, weekdays = cron_sets(pattern)
    fields = pattern.split()
    in_month, in_week = (lambda d: F.dayofmonth(d).isin(month_days)), (lambda d: F.pmod(F.weekday(d) + 1, F.lit(7)).isin(weekdays))
    either = not fields[2].startswith("*") and not fields[4].startswith("*")
    day_holds = lambda d: (in_month(d) | in_week(d)) if either else (in_month(d) & in_week(d))
    days = F.filter(F.sequence(F.to_date(after), F.to_date(until)), lambda d: F.month(d).isin(months) & day_holds(d))
    times = F.array(*(F.lit(h * 60 + m) for h in hours for m in minutes)) if len(hours) * len(minutes) <= 1440 else None
    slots = F.flatten(F.transform(days, lambda d: F.transform(times, lambda t: F.timestamp_seconds(F.unix_date(d).cast("long") * 86400 + t * 60))))
    return F.filter(slots, lambda s: (s > after) & (s <= until))


def rule_until(rule: Column) -> tuple[Column, Column]:
    """The moment of a rule's UNTIL, null where it names a day only, and whether it is in UTC."""
    written = F.regexp_extract(F.upper(rule), r"UNTIL=(\d{8}T\d{6})(Z?)", 1)
    return F.try_to_timestamp(F.nullif(written, F.lit("")), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"), F.upper(rule).rlike(r"UNTIL=\d{8}T\d{6}Z")


def row_rule_days(rule: Column, start: Column, last: Column, more: int = 0) -> Column:
    """rule_days for a rule that differs from row to row, as a column. A rule that can't be expanded gives null.

    more: days after that of UNTIL to take in, for callers that compare moments with rule_until.
    """
    text = F.upper(F.regexp_replace(rule, "(?i)^RRULE:|;$", ""))
    parts = F.str_to_map(text, F.lit(";"), F.lit("="))
    part = lambda name: F.try_element_at(parts, F.lit(name))
    numbers = lambda name: F.coalesce(F.transform(F.split(part(name), ","), lambda x: x.try_cast("int")), F.array().cast("array<int>"))
    freq, every = part("FREQ"), F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1))
    names = F.array(*map(F.lit, DAYS))
    by_day = F.coalesce(F.transform(F.split(part("BYDAY"), ","), lambda x: F.struct(F.coalesce(F.regexp_extract(x, r"^([+-]?\d*)", 1).try_cast("int"), F.lit(0)).alias("n"), (F.array_position(names, F.right(x, F.lit(2))) - 1).cast("int").alias("w"))), F.array().cast("array<struct<n:int,w:int>>"))
    month_days, months = numbers("BYMONTHDAY"), numbers("BYMONTH")
    week_start = F.coalesce(F.array_position(names, part("WKST")) - 1, F.lit(0)).cast("int")
    until = F.try_to_date(F.substring(part("UNTIL"), 1, 8), "yyyyMMdd")
    end = F.least(last, F.coalesce(F.date_add(until, more), last))
    known = freq.isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY") & (F.size(F.array_except(F.map_keys(parts), F.array(*map(F.lit, sorted(PARTS))))) == 0) & (every > 0) & ~F.exists(by_day, lambda m: m.w < 0)
    # Bound once a row: within a lambda, each use of an expression is evaluated anew for every day.
    bound = F.struct(
        freq.alias("freq"), every.alias("every"), by_day.alias("by_day"), month_days.alias("month_days"), months.alias("months"), week_start.alias("week_start"),
        start.alias("start"), end.alias("end"), part("COUNT").try_cast("int").alias("count"),
    )

    def expanded(r: Column) -> Column:
        of = lambda name: r.getField(name)
        month_no = lambda x: F.year(x) * 12 + F.month(x)
        first_of_week = lambda x: F.date_sub(x, F.pmod(F.weekday(x) - of("week_start"), F.lit(7)).cast("int"))

        def holds(d: Column) -> Column:
            in_period = (
                F.when(of("freq") == "DAILY", F.datediff(d, of("start")) % of("every") == 0)
                .when(of("freq") == "WEEKLY", (F.datediff(first_of_week(d), first_of_week(of("start"))) / 7).cast("int") % of("every") == 0)
                .when(of("freq") == "MONTHLY", (month_no(d) - month_no(of("start"))) % of("every") == 0)
                .otherwise((F.year(d) - F.year(of("start"))) % of("every") == 0)
            )
            no_days, no_month_days, no_months = F.size(of("by_day")) == 0, F.size(of("month_days")) == 0, F.size(of("months")) == 0
            by_month_day = F.array_contains(of("month_days"), F.dayofmonth(d)) | F.array_contains(of("month_days"), F.datediff(d, F.last_day(d)) - 1)
            in_year = (of("freq") == "YEARLY") & no_months
            from_start = F.floor((F.when(in_year, F.dayofyear(d)).otherwise(F.dayofmonth(d)) - 1) / 7) + 1
            from_end = -(F.floor(F.datediff(F.when(in_year, F.make_date(F.year(d), F.lit(12), F.lit(31))).otherwise(F.last_day(d)), d) / 7) + 1)
            plain = of("freq").isin("DAILY", "WEEKLY")
            of_days = F.exists(of("by_day"), lambda m: (m.w == F.weekday(d)) & ((m.n == 0) | plain | (m.n == from_start) | (m.n == from_end)))
            own = F.when(of("freq") == "WEEKLY", F.weekday(d) == F.weekday(of("start"))).when(of("freq") == "MONTHLY", F.dayofmonth(d) == F.dayofmonth(of("start"))).when(of("freq") == "YEARLY", (F.dayofmonth(d) == F.dayofmonth(of("start"))) & (~no_months | (F.month(d) == F.month(of("start"))))).otherwise(True)
            return in_period & (no_months | F.array_contains(of("months"), F.month(d))) & (no_month_days | by_month_day) & (no_days | of_days) & (~(no_days & no_month_days) | own)

        days = F.array_sort(F.array_union(F.array(of("start")), F.filter(F.sequence(of("start"), of("end")), holds)))
        return F.slice(days, F.lit(1), F.coalesce(of("count"), F.size(days)))

    limited = F.get(F.transform(F.array(bound), expanded), F.lit(0))
    return F.when(known & (end >= start), limited).when(known, F.array().cast("array<date>"))


def cron_pattern(settings: dict) -> str:
    """The cron pattern of a schedule: its own (CUSTOM), or every so many DAYS, HOURS or MINUTES."""
    kind, schedule = settings.get("type"), settings.get("schedule") or {}
    if kind in (None, "CUSTOM") and isinstance(settings.get("pattern"), str):
        return settings["pattern"]

    def whole(name: str, least: int, most: float = float("inf")) -> int:
        n = schedule.get(name)
        if type(n) is not int or not least <= n <= most:
            raise RuleError(f"a schedule by {kind} needs a whole {name} from {least}" + (f" to {most}" if most < float("inf") else ""))
        return n

    if kind == "DAYS":
        return f"{whole('minute', 0, 59)} {whole('hour', 0, 23)} */{whole('day', 1)} * *"
    if kind == "HOURS":
        return f"{whole('minute', 0, 59)} */{whole('hour', 1)} * * *"
    if kind == "MINUTES":
        return f"*/{whole('minute', 1, 60)} * * * *"
    raise RuleError("a schedule needs a pattern, or a type of DAYS, HOURS, MINUTES or CUSTOM")
