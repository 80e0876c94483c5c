"""Mail and calendar files as rows. Files are dealt by Spark; a task parses one file after the other."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from ..functions.zones import zone_name

SPACES = re.compile(r"[ \t\r\n\f]+")
MESSAGE = "path string, message_id string, in_reply_to array<string>, references array<string>, subject string, sender string, recipients array<string>, sent_at timestamp, text string, html string, n_attachments int, bulk boolean, error string"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A row a message of .eml and .mbox files; unreadable ones have an error. A mailbox is dealt by message, at lines that begin with `From `."""
    ship(spark)
    box = F.lower("_metadata.file_name").rlike(r"\.mbo?x$")  # files are left out before they are read
    source = spark.read.option("recursiveFileLookup", True)
    mails = source.format("binaryFile").load(path).where(~box).select("path", "content")
    boxed = source.option("lineSep", "\nFrom ").text(path).where(box).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    return mails.mapInPandas(_messages, MESSAGE).unionByName(boxed.mapInPandas(_boxed, MESSAGE))


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            parts = [b"From " + p for p in content.replace(b"\r\n", b"\n").removeprefix(b"From ").split(b"\n\nFrom ")] if content.startswith(b"From ") else [content]
            rows = [_row(path, p.split(b"\n", 1)[-1] if content.startswith(b"From ") else p) for p in parts]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MESSAGE.split(", ")])


def _boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_row(path, content.replace(b"\r\n", b"\n").removesuffix(b"\r").split(b"\n", 1)[-1]) for path, content in zip(batch.path, batch.content, strict=True) if content.strip()]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in MESSAGE.split(", ")])


def _row(path: str, data: bytes) -> tuple:
    try:
        m = message_from_bytes(data, policy=policy.default)
        ids = lambda name: str(m.get(name, "")).split()
        addresses = lambda *names: [a.lower() for _, a in getaddresses([str(v) for n in names for v in m.get_all(n, [])]) if a]
        body = {k: (part.get_content() if (part := m.get_body((k,))) else None) for k in ("plain", "html")}
        try:
            at = parsedate_to_datetime(str(m["date"])) if m["date"] else None
        except ValueError:
            at = None
        bulk = any(m.get(h) for h in ("list-unsubscribe", "list-id")) or str(m.get("precedence", "")).lower() in ("bulk", "list", "junk")
        return path, (ids("message-id") or [None])[0], ids("in-reply-to"), ids("references"), str(m.get("subject", "")), (addresses("from") or [None])[0], addresses("to", "cc"), pd.Timestamp(at).tz_convert(None) if at is not None and at.tzinfo else at, body["plain"], body["html"], sum(1 for _ in m.iter_attachments()), bool(bulk), None
    except (LookupError, ValueError, AttributeError, KeyError) as e:
        return path, None, [], [], None, None, [], None, None, None, 0, False, str(e)


#: Elements that are never shown, that end a line, and that have no end of their own.
HIDDEN = frozenset("script style head title template noscript".split())
LINES = frozenset("p div tr h1 h2 h3 h4 h5 h6 ul ol table blockquote section article header footer".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Shown(HTMLParser):
    """The text of a page as it is shown. Hidden parts end with the element that hides, however deep they nest."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []  # elements, and whether each of them hides
        self.standing: Counter[str] = Counter()  # how many of each tag are open
        self.hiding = 0
        self.feed(html)
        self.close()

    def _line(self, text: str = "\n") -> None:
        if not self.hiding:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self._line()
        if tag in EMPTY:
            return
        given = dict(attrs)
        hides = tag in HIDDEN or "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        self.open.append((tag, hides))
        self.standing[tag] += 1
        self.hiding += hides
        self._line("\n- " if tag == "li" else "\n" if tag in LINES else "")

    def handle_endtag(self, tag: str) -> None:
        if not self.standing[tag]:  # an end without a start ends nothing
            return
        while True:
            name, hides = self.open.pop()
            self.standing[name] -= 1
            self.hiding -= hides
            if name == tag:
                break
        self._line(" | " if tag in ("td", "th") else "\n" if tag in LINES or tag == "li" else "")

    def handle_data(self, data: str) -> None:
        self._line(SPACES.sub(" ", data))

    def text(self) -> str:
        tidy = re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(self.out)))
        return re.sub(r"\n{3,}", "\n\n", tidy).strip(" \n").replace("\xa0", " ")


def html_text(html: Column) -> Column:
    """Readable text of a mail's HTML: hidden parts go, blocks become lines, list items get a dash, references are decoded."""
    return _html_text(html)


@F.pandas_udf(T.StringType())
def _html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda t: _Shown(t).text(), na_action="ignore")


EVENT_LINES = r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"
ZONE_LINES = r"(?s)BEGIN:VTIMEZONE\r?\n(.*?)END:VTIMEZONE"


def unfolded(text: Column) -> Column:
    """An iCalendar text with its continued lines joined."""
    return F.regexp_replace(text, r"\r?\n[ \t]", "")


def own_lines(component: Column) -> Column:
    """A component's own lines, without those of components within it, such as an event's alarms."""
    return F.regexp_replace(component, r"(?s)BEGIN:([A-Z-]+)\r?\n.*?END:\1(?:\r?\n|\z)", "")


def calendar_events(df: DataFrame, text: str = "text", default_zone: str = "UTC") -> DataFrame:
    """A row a VEVENT of iCalendar texts: unfolded, unescaped; wall clock times with their zone.

    zone is an IANA name or an offset, whatever name the calendar uses, and null for floating times; a name that the calendar defines itself takes its
    standard offset here, and own_zone is that name, for own_zones.to_utc. A name that nothing knows is read as default_zone, and
    zone_note says so. ends comes from DTEND or DURATION; excluded and added are the moments of EXDATE and RDATE, replaces that
    of a RECURRENCE-ID, which stands for one occurrence of a series: all on the event's own clock, in whatever zone they are written.
    excluded_utc are the moments of EXDATE that are written in UTC.
    """
    kept = [c for c in df.columns if c != text]
    flat = unfolded(F.col(text))
    own_zone = lambda b: F.struct(F.trim(F.regexp_extract(b, r"(?m)^TZID:(.*?)\r?$", 1)).alias("name"), F.regexp_extract(b, r"(?s)BEGIN:STANDARD.*?TZOFFSETTO:([+-]\d{4})", 1).alias("offset"))
    zones = F.transform(F.regexp_extract_all(flat, F.lit(ZONE_LINES), F.lit(1)), own_zone).cast("array<struct<name:string,offset:string>>")
    each = df.select(*kept, zones.alias("e_zones"), F.explode(F.regexp_extract_all(flat, F.lit(EVENT_LINES), F.lit(1))).alias("e")).withColumn("e", own_lines(F.col("e")))

    def line(name: str, group: int = 2) -> Column:
        return F.nullif(F.regexp_extract("e", rf"(?m)^{name}((?:;[^:\n]*)?):(.*?)\r?$", group), F.lit(""))

    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")
    zone_of = lambda parameters: F.nullif(F.regexp_extract(parameters, r"TZID=\"?([^;:\"]+)", 1), F.lit(""))

    def wall(v: Column) -> Column:
        return F.when(F.length(v) == 8, F.try_to_timestamp(v, F.lit("yyyyMMdd"))).otherwise(F.try_to_timestamp(F.regexp_replace(v, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))).cast("timestamp_ntz")

    def on_own_clock(v: Column, written: Column) -> Column:
        """A moment in the event's zone, of a value in UTC or in another zone."""
        zone = F.col("e_zone")
        other = F.when(v.endswith("Z"), "UTC").when(written != F.col("e_written"), zone_name(written, None, None))
        moved = F.from_utc_timestamp(F.to_utc_timestamp(wall(v).cast("timestamp"), other), zone).cast("timestamp_ntz")
        # In a zone that the calendar defines itself, moments in UTC are compared as instants.
        return F.when(F.col("e_own").isNotNull() & v.endswith("Z"), None).when(zone.isNotNull() & other.isNotNull() & (F.length(v) > 8), moved).otherwise(wall(v))

    def moments(name: str) -> Column:
        pattern = rf"(?m)^{name}((?:;[^:\n]*)?):(.*?)\r?$"
        listed = F.arrays_zip(F.regexp_extract_all(F.col("e"), F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(F.col("e"), F.lit(pattern), F.lit(2)).alias("v"))
        values = F.flatten(F.transform(listed, lambda x: F.transform(F.split(x.getField("v"), r"\s*,\s*"), lambda v: on_own_clock(v, zone_of(x.getField("p"))))))
        return F.filter(values, lambda x: x.isNotNull())

    excluded_utc = F.filter(F.transform(F.flatten(F.transform(F.regexp_extract_all(F.col("e"), F.lit(r"(?m)^EXDATE(?:;[^:\n]*)?:(.*?)\r?$"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*"))), lambda v: F.when(v.endswith("Z"), wall(v))), lambda x: x.isNotNull())
    offset = F.get(F.filter("e_zones", lambda z: z.getField("name") == F.col("e_written")), F.lit(0)).getField("offset")
    known = zone_name(F.col("e_written"), None, None)
    zone = F.when(F.col("e_start").endswith("Z"), "UTC").when(F.col("e_written").isNotNull(), zone_name(F.col("e_written"), offset, default_zone))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(F.col("e_length"), rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    clock = F.regexp_extract(F.col("e_length"), "T(.*)$", 1)
    timed = lambda unit: F.coalesce(F.nullif(F.regexp_extract(clock, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    length = F.make_dt_interval(part("W") * 7 + part("D"), timed("H"), timed("M"), timed("S"))
    lines = each.withColumns({"e_start": line("DTSTART"), "e_written": F.trim(zone_of(line("DTSTART", 1))), "e_length": line("DURATION")})
    lines = lines.withColumns({"e_zone": zone, "e_own": F.when(known.isNull() & F.exists("e_zones", lambda z: z.getField("name") == F.col("e_written")), F.col("e_written"))})
    starts = wall(F.col("e_start"))
    ends = F.coalesce(on_own_clock(line("DTEND"), zone_of(line("DTEND", 1))), F.when(F.col("e_length").isNotNull(), starts + length))
    note = F.when(F.col("e_written").isNotNull() & known.isNull() & F.col("e_own").isNull(), F.concat(F.lit("unknown time zone "), "e_written", F.lit(f", read as {default_zone}")))
    return lines.select(
        *kept, line("UID").alias("uid"), plain(line("SUMMARY")).alias("summary"), plain(line("LOCATION")).alias("location"), starts.alias("starts"), F.col("e_zone").alias("zone"), F.col("e_own").alias("own_zone"), note.alias("zone_note"), ends.alias("ends"),
        (F.length("e_start") == 8).alias("whole_day"), line("RRULE").alias("rule"), moments("EXDATE").alias("excluded"), excluded_utc.alias("excluded_utc"), moments("RDATE").alias("added"), on_own_clock(line("RECURRENCE-ID"), zone_of(line("RECURRENCE-ID", 1))).alias("replaces"),
        F.coalesce(line("SEQUENCE").try_cast("int"), F.lit(0)).alias("sequence"), wall(line("LAST-MODIFIED")).alias("modified"), (line("STATUS") == "CANCELLED").alias("cancelled"), line("CLASS").alias("class"),
    )
