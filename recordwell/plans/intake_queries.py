"""Mail and calendar intake, and named queries, over the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import kept, shared_folder
from ..functions.recurrence import row_rule_days
from ..operators import ingest, named, own_zones
from ..sources import delimited
from ..sources.mail import calendar_events
from . import crm
from .crm import MODEL, NOW, OPPORTUNITY
from .registry import query, spread, table


def _mail(n, host: str):
    return F.concat(F.lit("c"), n.cast("string"), F.lit(f"@{host}"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("message_id"), F.array(F.upper(_mail(F.col("o_custkey"), "x.org")), _mail(F.col("o_orderkey") % 50, "gmail.com"), F.concat(F.lit(" info@shop"), (F.col("o_orderkey") % 20).cast("string"), F.lit(".co.uk"))).alias("handles"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("person_id"), _mail(k, "x.org").alias("primary"), F.array(_mail(k + 1, "x.org"), _mail(k + 3, "x.org")).alias("additional"))


_OWNER = "a AS (SELECT c_custkey AS n, 0 AS extra, c_custkey AS p FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1, 1, c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 3, 1, c_custkey FROM customer WHERE c_custkey % 3 = 0), w AS (SELECT n, min_by(p, extra * 1000000 + p) AS p FROM a GROUP BY 1)"


@query("participants_linked", f"WITH {_OWNER} SELECT p AS person_id, count(*) AS n FROM orders JOIN w ON n = o_custkey GROUP BY 1 UNION ALL SELECT NULL, (SELECT count(*) FROM orders) * 2 + (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT n FROM w))")
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.participants(_messages(spark, sf_dir), _people(spark, sf_dir)).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contact_proposals",
    f"""WITH {_OWNER}, x AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) || '@x.org' AS address, o_orderkey, 'X' AS company, CASE WHEN o_custkey = 1001 THEN 'own_address' ELSE '' END AS reason FROM orders WHERE o_custkey NOT IN (SELECT n FROM w)
UNION ALL SELECT 'c' || CAST(o_orderkey % 50 AS VARCHAR) || '@gmail.com', o_orderkey, NULL, 'free_email' FROM orders UNION ALL SELECT 'info@shop' || CAST(o_orderkey % 20 AS VARCHAR) || '.co.uk', o_orderkey, 'Shop' || CAST(o_orderkey % 20 AS VARCHAR), CASE WHEN o_orderkey % 20 = 7 THEN 'blocklist' ELSE 'group_address' END FROM orders)
SELECT address, count(*) AS n_messages, company, reason FROM x GROUP BY address, company, reason""",
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ingest.participants(_messages(spark, sf_dir), _people(spark, sf_dir))
    return ingest.proposals(linked, ["c1001@x.org"], ["intern.example"], F.col("address").endswith("shop7.co.uk")).drop("domain")


@query(
    "delivery_actions",
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'BOUNCE' WHEN c_custkey % 4 = 1 THEN 'UNSUBSCRIBE' END AS new FROM customer), s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'UNSUBSCRIBE' ELSE 'COMPLAINT' END AS old, c_custkey % 10 = 0 AS deleted FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
j AS (SELECT r.c_custkey, new, old, CASE WHEN old IS NULL THEN 'create' WHEN deleted THEN 'restored' WHEN new = 'BOUNCE' AND old = 'UNSUBSCRIBE' THEN 'upgraded' ELSE 'unchanged' END AS action FROM r LEFT JOIN s ON r.c_custkey = s.c_custkey WHERE new IS NOT NULL)
SELECT 'c' || CAST(c_custkey AS VARCHAR) || '@x.org' AS address, CASE action WHEN 'unchanged' THEN old ELSE new END AS reason, action FROM j""",
)
def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    status = F.when(k % 4 == 0, "bounced").when(k % 4 == 1, "unsubscribed").otherwise("delivered")
    results = c.select(_mail(k, "X.org").alias("email"), status.alias("status")).union(c.where(k % 4 == 0).select(_mail(k, "x.org"), F.lit("unsubscribe")))
    stored = c.where((k % 2 == 0) | (k % 3 == 0)).select(_mail(k, "x.org").alias("address"), F.when(k % 3 == 0, "UNSUBSCRIBE").otherwise("COMPLAINT").alias("reason"), (k % 10 == 0).alias("deleted"))
    return ingest.delivery_actions(results, stored)


@query(
    "event_version_actions",
    "SELECT CASE WHEN c_custkey % 2 = 0 AND c_custkey % 14 = 0 THEN 'in_trash' WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN 'cancellation_unknown_event' WHEN c_custkey % 2 = 1 THEN 'create' WHEN c_custkey % 3 > 1 THEN 'update' WHEN c_custkey % 3 = 1 THEN 'fill' ELSE 'older_version' END AS action, count(*) AS n FROM customer GROUP BY 1",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, at = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit("2026-01-01").cast("timestamp")
    newest = c.select(k.alias("uid"), (k % 3).cast("int").alias("sequence"), at.alias("modified"), (k % 5 == 0).alias("cancelled"))
    stored = c.where(k % 2 == 0).select(k.alias("uid"), F.lit(1).alias("sequence"), at.alias("modified"), (k % 14 == 0).alias("deleted"))
    return ingest.version_actions(newest, stored).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "occurrences_between",
    """WITH e AS (SELECT s_suppkey AS uid, DATE '2026-03-02' + CAST(s_suppkey % 5 AS INTEGER) AS d0, s_suppkey % 4 AS r FROM supplier), d AS (SELECT uid, d0, r, CAST(d0 + CAST(k AS INTEGER) AS DATE) AS d FROM e, generate_series(0, 400) g(k)),
h AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d) AS n FROM d WHERE d = d0 OR (r = 1 AND date_diff('day', d0, d) % 3 = 0) OR (r = 2 AND isodow(d) IN (2, 5)) OR (r = 3 AND day(d) = day(d0))),
k AS (SELECT uid, d FROM h WHERE NOT (r = 1 AND n > 40) AND NOT (r = 2 AND d = DATE '2026-03-27')), u AS (SELECT uid, timezone('UTC', timezone('Europe/Berlin', CAST(d AS TIMESTAMP) + INTERVAL 9 HOUR)) AS t FROM k)
SELECT uid, strftime(t, '%Y-%m-%d %H:%M') AS starts FROM u WHERE t < TIMESTAMP '2026-05-01' AND t + INTERVAL 1 HOUR > TIMESTAMP '2026-03-20'""",
)
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    day = F.date_add(F.lit("2026-03-02").cast("date"), (k % 5).cast("int"))
    clock = lambda t: F.concat(day.cast("string"), F.lit(t)).cast("timestamp_ntz")
    rule = F.when(k % 4 == 1, "FREQ=DAILY;INTERVAL=3;COUNT=40").when(k % 4 == 2, "RRULE:FREQ=WEEKLY;BYDAY=TU,FR").when(k % 4 == 3, "FREQ=MONTHLY")
    skipped = F.when(k % 4 == 2, F.array(F.lit("2026-03-27 09:00:00").cast("timestamp_ntz")))
    events = table(spark, sf_dir, "supplier").select(k.alias("uid"), clock(" 09:00:00").alias("starts"), clock(" 10:00:00").alias("ends"), F.lit("Europe/Berlin").alias("zone"), rule.alias("rule"), skipped.alias("excluded"))
    none = events.limit(0).select("uid", F.col("starts").alias("replaces"), "starts", "ends", "zone")
    at = lambda t: F.lit(t).cast("timestamp")
    return ingest.occurrences_between(events, none, at("2026-03-20"), at("2026-05-01")).select("uid", F.date_format("starts", "yyyy-MM-dd HH:mm").alias("starts"))


@query(
    "row_rules",
    """WITH d AS (SELECT r_regionkey, CAST(DATE '2026-01-30' + CAST(k AS INTEGER) AS DATE) AS d FROM region, generate_series(0, 800) g(k))
SELECT r_regionkey, count(*) AS n, max(d) AS last_day FROM d WHERE d = DATE '2026-01-30' OR (r_regionkey = 0 AND d = last_day(d)) OR (r_regionkey = 1 AND isodow(d) = 5 AND day(d) <= 7 AND month(d) % 2 = 1) OR (r_regionkey = 2 AND month(d) = 2 AND day(d) = 28) OR (r_regionkey = 3 AND isodow(d) = 1 AND date_diff('day', DATE '2026-01-26', d) % 21 = 0) OR (r_regionkey = 4 AND isodow(d) = 5 AND day(d) + 7 > day(last_day(d))) GROUP BY 1""",
)
def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["FREQ=MONTHLY;BYMONTHDAY=-1", "FREQ=MONTHLY;INTERVAL=2;BYDAY=1FR", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=28", "FREQ=WEEKLY;INTERVAL=3;BYDAY=MO", "FREQ=MONTHLY;BYDAY=-1FR"]
    rule = F.get(F.array(*map(F.lit, rules)), F.col("r_regionkey"))
    start, last = F.lit("2026-01-30").cast("date"), F.date_add(F.lit("2026-01-30").cast("date"), 800)
    return table(spark, sf_dir, "region").select("r_regionkey", row_rule_days(rule, start, last).alias("d")).select("r_regionkey", F.size("d").cast("long").alias("n"), F.array_max("d").alias("last_day"))


@query("find_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0")
def find_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crm.opportunities(spark, sf_dir).withColumn("crm_deleted_at", F.when(F.col("o_orderkey") % 4 == 0, F.col("closeDate")))
    return named.find(rows, OPPORTUNITY, NOW, {"field": "stage", "operand": "is", "value": "f"})[0]


@query("get_incoming", "SELECT 'opportunity' AS source_object, 'company' AS field, CAST(o_orderkey AS VARCHAR) AS source_id FROM orders WHERE o_custkey = 7")
def get_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.lit("company").alias("object"), F.col("user_id").cast("string").alias("record_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return named.get(MODEL, {"company": crm.companies(spark, sf_dir), "opportunity": crm.opportunities(spark, sf_dir)}, log, "company", "7")["incoming"]


@query("timeline_with_titles", "SELECT event_id AS seq, c_name AS title FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) LEFT JOIN customer ON c_custkey = user_id")
def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.lit("company").alias("object"), F.col("user_id").cast("string").alias("record_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return named.timeline(log, crm.companies(spark, sf_dir), limit=100).select("seq", "title")


_ICS = [
    "BEGIN:VCALENDAR", "BEGIN:VTIMEZONE", "TZID:Our zone", "BEGIN:DAYLIGHT", "DTSTART:19810329T020000", "TZOFFSETFROM:+0100", "TZOFFSETTO:+0200", "RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU", "END:DAYLIGHT",
    "BEGIN:STANDARD", "DTSTART:19961027T030000", "TZOFFSETFROM:+0200", "TZOFFSETTO:+0100", "RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU", "END:STANDARD", "END:VTIMEZONE", "BEGIN:VEVENT", "UID:{uid}", "DTSTART;TZID={zone}:2026032{d}T083000",
    "BEGIN:VALARM", "TRIGGER:-PT10M", "DURATION:PT5M", "END:VALARM", "DURATION:PT45M", "RRULE:FREQ=DAILY;UNTIL=20261105T073000Z", "EXDATE:20260406T063000Z", "END:VEVENT", "END:VCALENDAR", "",
]


@query(
    "calendar_occurrences",
    """WITH d AS (SELECT s_suppkey AS uid, s_suppkey % 4 AS z, CAST(DATE '2026-03-20' + CAST(s_suppkey % 5 AS INTEGER) + CAST(k AS INTEGER) AS TIMESTAMP) + INTERVAL 510 MINUTE AS t FROM supplier, generate_series(0, 300) g(k)),
u AS (SELECT uid, z, timezone('UTC', timezone(CASE WHEN z = 3 THEN 'Asia/Bangkok' ELSE 'Europe/Berlin' END, t)) AS t FROM d)
SELECT CAST(uid AS VARCHAR) AS uid, strftime(t, '%Y-%m-%d %H:%M') AS starts, strftime(t + INTERVAL 45 MINUTE, '%H:%M') AS ends FROM u WHERE t <= TIMESTAMP '2026-11-05 07:30:00' AND t <> TIMESTAMP '2026-04-06 06:30:00'""",
)
def calendar_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events over both switches of a year, from calendar texts: a zone of the calendar's own, a Windows name, a vendor's path, and one far away."""
    k = F.col("s_suppkey")
    zone = F.when(k % 4 == 0, "Our zone").when(k % 4 == 1, "W. Europe Standard Time").when(k % 4 == 2, "/vendor.example/tz/Europe/Berlin").otherwise("SE Asia Standard Time")
    text = F.lit("\r\n".join(_ICS))
    for name, column in (("{uid}", k.cast("string")), ("{zone}", zone), ("{d}", (k % 5).cast("string"))):
        text = F.replace(text, F.lit(name), column)
    texts = spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(k.cast("string").alias("uid"), text.alias("text"))
    texts = texts.withColumn("blocks", own_zones.zone_blocks(F.col("text"))).withColumn("zones", own_zones.definition(F.col("blocks")))
    events = kept(calendar_events(texts.select("zones", "text")), "events")  # parsed once, then expanded
    defined = kept(texts.select("zones", "blocks").distinct(), "definitions")  # few, as calendars share them
    moves = own_zones.transitions(own_zones.observances(defined, None), ["zones"], 2026, 2026)
    none = events.limit(0).select("uid", "replaces", "starts", "ends", "zone")
    found = ingest.occurrences_between(events, none, F.lit("2026-03-01").cast("timestamp"), F.lit("2026-12-01").cast("timestamp"), moves, ("zones",))
    return found.select("uid", F.date_format("starts", "yyyy-MM-dd HH:mm").alias("starts"), F.date_format("ends", "HH:mm").alias("ends"))


@query("delimited_round_trip", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(lang, '') || '; "' || coalesce(source, '') || '"' AS note FROM documents""")
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with their line breaks and quotes, written as delimited files and read again by splits."""
    docs = table(spark, sf_dir, "documents")
    note = F.concat(F.coalesce("lang", F.lit("")), F.lit('; "'), F.coalesce("source", F.lit("")), F.lit('"'))
    cells = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), note.alias("note"))
    path = f"{shared_folder(spark)}/recordwell-delimited-{uuid.uuid4().hex}"
    cells.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return delimited.read_table(spark, path).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "note")
