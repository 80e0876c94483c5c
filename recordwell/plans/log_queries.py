"""Relations, change log, search, text and documents over the sample tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import shared_folder
from ..functions import text as X
from ..functions.values import value
from ..operators import differences, graph, relations, search, timeline
from ..operators.aggregates import aggregate_column
from ..schema import Model
from ..sources import change_log, sinks
from . import crm
from .crm import MODEL, OPPORTUNITY
from .registry import query, spread, table


@query("inverse_relation", "SELECT CAST(c_custkey AS VARCHAR) AS crm_id, count(o_orderkey) AS n_sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1")
def inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    opps = crm.opportunities(spark, sf_dir).withColumn("crm_deleted_at", F.when(F.col("stage") == "P", F.col("closeDate")))
    return relations.inverse(crm.companies(spark, sf_dir), opps, OPPORTUNITY, "company")


@query("incoming_edges", "SELECT 'opportunity' AS source_object, 'company' AS field, 'company' AS target_object, count(*) AS n, count(DISTINCT o_custkey) AS n_targets FROM orders")
def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relations.edges(MODEL, {"opportunity": crm.opportunities(spark, sf_dir)})
    return edges.groupBy("source_object", "field", "target_object").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("n_targets"))


@query("two_hop_activity", "SELECT c_nationkey AS a, count(DISTINCT l_suppkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 GROUP BY 1")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    of_nation = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("a"), F.col("o_orderkey").alias("b"))
    bought = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("b"), F.col("l_suppkey").alias("c"))
    return relations.two_hops(of_nation, bought).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query("anti_join_orphans", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment <> 'BUILDING')")
def orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return relations.orphans(table(spark, sf_dir, "orders"), "o_custkey", kept, "c_custkey").select("o_orderkey", "o_custkey")


@query("link_current_title", "SELECT CAST(o_orderkey AS VARCHAR) AS crm_id, coalesce(c_name, 'gone') AS title, c_custkey IS NOT NULL AS found, coalesce(c_custkey % 7 = 0, false) AS deleted FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the companies every fifth is gone and every seventh in the trash."""
    companies = crm.companies(spark, sf_dir).where("c_custkey % 5 <> 0").withColumn("crm_deleted_at", F.when(F.col("c_custkey") % 7 == 0, F.lit("2020-01-01").cast("timestamp")))
    now = relations.with_titles(crm.opportunities(spark, sf_dir), "company", companies, "company")
    return now.select("crm_id", F.coalesce("company_now.title", F.lit("gone")).alias("title"), F.col("company_now.exists").alias("found"), F.col("company_now.deleted").alias("deleted"))


_HOST = r"regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), ':\d*$', ''), '^www\.', '')"


@query("theta_blocklist", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), b AS (SELECT unnest(['example.org', 'm.ththth.example.net', 'cheap-pills.example.com']) AS e) SELECT page_id, host FROM h WHERE EXISTS (SELECT 1 FROM b WHERE host = e OR ends_with(host, '.' || e))")
def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", X.host_key(F.col("url")).alias("host"))
    entries = F.array(*map(F.lit, ["example.org", "m.ththth.example.net", "@cheap-pills.example.com"]))
    return pages.where(X.is_blocklisted(F.concat(F.lit("x@"), F.col("host")), entries))


@query("normalize_url_host", f"SELECT page_id, {_HOST} AS host, {_HOST} || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '#.*$', ''), '/+$', '') AS url_key FROM pages")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.host_key(F.col("url")).alias("host"), X.url_key(F.col("url")).alias("url_key"))


@query("timeline_since", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE k <= 200")
def since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events: the limit is the feature."""
    rows = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-10'")
    return timeline.tail(rows, [F.col("ts"), F.col("event_id")], 200).select("user_id", "event_id", "event_type")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


_INTERVALS = """WITH e AS (SELECT user_id AS record_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = crm.stage_changes(spark, sf_dir)
    records = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record_id")).agg(F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit("").alias("value"))
    return timeline.stage_intervals(changes, records)


@query("stage_intervals", _INTERVALS + " SELECT record_id, event_type AS stage, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started, strftime(nx, '%Y-%m-%d %H:%M:%S') AS ended FROM e")
def stage_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _intervals(spark, sf_dir).select("record_id", "stage", show("start").alias("started"), show("end").alias("ended"))


@query(
    "time_in_stage",
    _INTERVALS
    + """, s AS (SELECT event_type AS stage, nx IS NULL AS open, epoch_us(coalesce(nx, TIMESTAMP '2024-02-01')) // 1000000 - epoch_us(ts) // 1000000 AS s FROM e)
SELECT stage, count(*) FILTER (NOT open) AS completed_intervals, CAST(round(CAST(CAST(floor(sum(s) FILTER (NOT open) / count(*) FILTER (NOT open)) AS BIGINT) AS DECIMAL(20,0)) / 86400, 2) AS DECIMAL(18,2)) AS average_days_completed,
 count(*) FILTER (open) AS records_in_stage, CAST(round(CAST(CAST(floor(sum(s) FILTER (open) / count(*) FILTER (open)) AS BIGINT) AS DECIMAL(20,0)) / 86400, 2) AS DECIMAL(18,2)) AS average_days_now, CAST(0 AS BIGINT) AS intervals_without_start FROM s GROUP BY 1""",
)
def time_in_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.time_in_stage(_intervals(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query(
    "stage_intervals_renamed",
    """WITH e AS (SELECT user_id AS record_id, ts, event_id, CASE WHEN event_id % 7 < 2 THEN 'migration' WHEN event_id % 7 = 2 THEN 'import' ELSE 'event' END AS kind, CASE WHEN event_id % 7 < 2 THEN event_type WHEN event_id % 13 = 0 THEN 'lead' END AS before,
 CASE WHEN event_id % 35 = 0 THEN NULL WHEN event_id % 7 = 0 THEN event_type || '2' WHEN event_id % 7 = 1 THEN substr(event_type, 1, 4) WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN event_type || '2' ELSE event_type END END AS after FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT record_id, CASE WHEN record_id % 2 = 0 THEN TIMESTAMP '2023-12-01' END AS created_at, CASE WHEN record_id % 9 = 0 THEN TIMESTAMP '2030-01-01' END AS deleted_at, CASE WHEN record_id % 3 <> 0 THEN 'idle' END AS value FROM (SELECT user_id AS record_id FROM events UNION SELECT c_custkey FROM customer)),
m AS (SELECT *, lead(ts) OVER w AS next_at, coalesce(count(*) FILTER (before IS NOT NULL OR after IS NOT NULL) OVER (PARTITION BY record_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM o WHERE kind <> 'migration' WINDOW w AS (PARTITION BY record_id ORDER BY ts, event_id)),
i AS (SELECT record_id, n, before AS stage, created_at AS start, ts AS ends, CASE WHEN created_at IS NULL THEN 'unknown' ELSE 'crm_created_at' END AS basis FROM m JOIN r USING (record_id) WHERE earlier = 0 AND before IS NOT NULL UNION ALL SELECT record_id, n, after, ts, coalesce(next_at, deleted_at), kind FROM m JOIN r USING (record_id) WHERE after IS NOT NULL),
g AS (SELECT record_id, list({'n': n, 'b': before, 'a': after, 'ts': ts} ORDER BY n) AS ms FROM o WHERE kind = 'migration' GROUP BY 1),
f AS (SELECT i.*, list_reduce(list_prepend({'n': i.n, 'b': CAST(NULL AS VARCHAR), 'a': i.stage, 'ts': CAST(NULL AS TIMESTAMP)}, list_filter(coalesce(ms, []), lambda x: x.n > i.n)), lambda x, y: CASE WHEN x.a = y.b THEN y ELSE x END) AS z FROM i LEFT JOIN g USING (record_id))
SELECT record_id, z.a AS stage, strftime(start, '%Y-%m-%d %H:%M:%S') AS started, strftime(CASE WHEN z.a IS NULL AND (ends IS NULL OR ends > z.ts) THEN z.ts ELSE ends END, '%Y-%m-%d %H:%M:%S') AS ended, basis FROM f
UNION ALL SELECT record_id, value, strftime(created_at, '%Y-%m-%d %H:%M:%S'), strftime(deleted_at, '%Y-%m-%d %H:%M:%S'), CASE WHEN created_at IS NULL THEN 'unknown' ELSE 'crm_created_at' END FROM r WHERE value IS NOT NULL AND record_id NOT IN (SELECT record_id FROM i)""",
)
def stage_intervals_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of moves, imports, clears and renamings, chains of them among these; records in the trash and records that never moved."""
    event, kind = F.col("event_id"), F.col("event_type")
    e = table(spark, sf_dir, "events")
    renames = event % 7 < 2
    after = F.when(event % 35 == 0, None).when(event % 7 == 0, F.concat(kind, F.lit("2"))).when(event % 7 == 1, F.substring(kind, 1, 4)).when(event % 11 != 0, F.when(event % 3 == 0, F.concat(kind, F.lit("2"))).otherwise(kind))
    changes = e.select(
        F.col("user_id").alias("record_id"), F.col("ts").cast("timestamp").alias("at"), event.alias("seq"), F.when(renames, kind).when(event % 13 == 0, "lead").alias("before"), after.alias("after"),
        F.when(renames, "migration").when(event % 7 == 2, "import").otherwise("event").alias("kind"),
    )
    day = lambda text: F.lit(text).cast("timestamp")
    records = e.select(F.col("user_id").alias("record_id")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    record = F.col("record_id")
    records = records.select("record_id", F.when(record % 2 == 0, day("2023-12-01")).alias("created_at"), F.when(record % 9 == 0, day("2030-01-01")).alias("deleted_at"), F.when(record % 3 != 0, "idle").alias("value"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return timeline.stage_intervals(changes, records).select("record_id", "stage", show("start").alias("started"), show("end").alias("ended"), "basis")


@query("stage_since", "SELECT user_id AS record_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since FROM events GROUP BY 1")
def stage_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.stage_since(crm.stage_changes(spark, sf_dir)).select("record_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query(
    "run_summaries",
    """WITH e AS (SELECT user_id AS run_id, ts, event_id, event_type AS status, 'step' || CAST(event_id % 4 AS VARCHAR) AS step, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'DONE' END AS result FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1)
SELECT l.run_id, l.status, count(*) AS n_steps, count(*) FILTER (s.result = 'FAILED') AS n_failed, (SELECT count(DISTINCT event_id % 10) FROM e x WHERE x.run_id = l.run_id) AS n_outbox FROM l JOIN s ON l.run_id = s.run_id GROUP BY l.run_id, l.status""",
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.concat(F.lit("step"), (F.col("event_id") % 4).cast("string"))
    log = e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("logged_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.create_map(step, F.when(F.col("event_type") == "error", "FAILED").otherwise("DONE")).alias("steps"), F.array((F.col("event_id") % 10).cast("string")).alias("outbox"))
    return timeline.run_summaries(log).drop("logged_at")


_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    "record_search",
    f"""WITH w AS (SELECT doc_id, {_W} AS b, regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
c AS (SELECT doc_id, b, t, len(list_filter(b, lambda x: x = 'the')) AS n1, len(list_filter(b, lambda x: starts_with(x, 'the'))) AS p1, len(list_filter(b, lambda x: x = 'ering')) AS n2, len(list_filter(b, lambda x: starts_with(x, 'ering'))) AS p2 FROM w),
s AS (SELECT doc_id, CASE WHEN n1 > 0 THEN least(n1, 3) * 10 WHEN p1 > 0 THEN 5 ELSE 0 END + CASE WHEN n2 > 0 THEN least(n2, 3) * 10 WHEN p2 > 0 THEN 5 ELSE 0 END + CASE WHEN contains(' ' || array_to_string(b, ' ') || ' ', 'the ering') THEN 20 ELSE 0 END AS v, (n1 > 0 OR p1 > 0) AND (n2 > 0 OR p2 > 0) AS everything FROM c)
SELECT doc_id, CAST((v + CASE WHEN everything THEN 50 ELSE 0 END) / 10.0 AS DECIMAL(18,2)) AS score FROM s WHERE v > 0""",
)
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return search.search_records(docs, "The ering", [("title", "title", F.col("source")), ("body", "RICH_TEXT", F.col("text"))], keep=["doc_id"])


@query(
    "page_search",
    f"""WITH w AS (SELECT doc_id, {_W} AS b, split_part(text, chr(10), 1) AS h FROM documents), c AS (SELECT doc_id, b, regexp_extract_all(lower(h), '[\\p{{L}}\\p{{N}}]+') AS t FROM w),
n AS (SELECT doc_id, list_transform(['ering', 'der', 'leaux'], lambda q: least(len(list_filter(b, lambda x: x = q)), 3) + 10 * least(len(list_filter(t, lambda x: x = q)), 3)) AS v FROM c)
SELECT doc_id, CAST(list_sum(v) + 6.0 * len(list_filter(v, lambda x: x > 0)) / 3 AS DECIMAL(18,4)) AS score FROM n WHERE list_sum(v) > 0""",
)
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = search.search_pages(docs, "ering der leaux", {"title": F.substring_index("text", "\n", 1), "body": F.col("text")})
    return found.select("doc_id", "score")


@query("facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("duplicates_exact", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.duplicate_groups(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@query("thread_root", "SELECT conv_id, count(*) AS n, max(turn) AS last_turn, count(DISTINCT role) AS n_roles, min_by(role, turn) AS opened_by FROM conversations GROUP BY 1")
def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = lambda turn: F.concat_ws("-", "conv_id", turn.cast("string"))
    c = table(spark, sf_dir, "conversations").withColumn("root", X.thread_root(F.array(message(F.lit(0))), F.array().cast("array<string>"), message(F.col("turn")), F.col("text")))
    out = c.groupBy("root").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("n_roles"), F.min_by("role", "turn").alias("opened_by"))
    return out.drop("root")


#: The patterns of X.SECRETS for an engine without look-around: (kind, pattern, replacement).
_SECRETS = [
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "[redacted:private-key]"), ("json-web-token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "[redacted:json-web-token]"),
    ("url-credentials", r"://[^\s/:@]+:[^\s/@]+@", "://[redacted:url-credentials]@"), ("access-key", r"\bAKIA[0-9A-Z]{16}\b", "[redacted:access-key]"),
    ("credential-phrase", r"(?i)\b(?:password|passwd|passwort|secret|token|api[_-]?key)\b\s*[:=]\s*[\"'']?[^\s\"'']{6,}[\"'']?", "[redacted:credential-phrase]"),
]
_clean = reduce(lambda sql, s: f"regexp_replace({sql}, '{s[1]}', '{s[2]}', 'g')", _SECRETS, "text")
_kinds = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p, _ in _SECRETS)


@query("redact_credentials", f"SELECT doc_id, concat_ws(',', {_kinds}) AS kinds, sha256({_clean}) AS clean_sha256 FROM documents WHERE concat_ws(',', {_kinds}) <> ''")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.secret_kinds(F.col("text")).alias("kinds"), X.redact(F.col("text")).alias("clean"))
    return docs.where(F.size("kinds") > 0).select("doc_id", F.array_join("kinds", ",").alias("kinds"), F.sha2("clean", 256).alias("clean_sha256"))


_LABELLED = "'Zugang ' || CAST(doc_id AS VARCHAR) || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'Passwort:' || chr(10) || '  geheim' || doc_id WHEN 1 THEN 'Ihre PIN :' || chr(10) || chr(10) || 'x' || doc_id || ' ' WHEN 2 THEN 'Secret:' || chr(10) || 'two words' WHEN 3 THEN 'your passcode: abc' || doc_id ELSE 'see https://x.org/a?id=7&token=t' || doc_id || '#p' END || chr(10)"
_MASKED = "'Zugang ' || CAST(doc_id AS VARCHAR) || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'Passwort:' || chr(10) || '  [redacted:credential-line]' WHEN 1 THEN 'Ihre PIN :' || chr(10) || chr(10) || '[redacted:credential-line] ' WHEN 2 THEN 'Secret:' || chr(10) || 'two words' WHEN 3 THEN 'your passcode: [redacted:credential-line]' ELSE 'see https://x.org/a?id=7&token=[redacted:url-parameter]#p' END || chr(10)"


@query("redact_by_line", f"SELECT doc_id, sha256({_MASKED} || {_clean}) AS clean_sha256 FROM documents")
def redacted_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each behind a label with its secret on the same line, on a later one, in a URL, or without one."""
    made = F.expr(_LABELLED.replace("chr(10)", "'\\n'").replace("CAST(doc_id AS VARCHAR)", "CAST(doc_id AS STRING)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact_all(F.concat(made, "text")), 256).alias("clean_sha256"))


@query(
    "unsubscribe_addresses",
    "SELECT c_custkey, c_custkey % 7 IN (0, 1, 4) AS unsubscribes FROM customer",
)
def unsubscribe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t = k.cast("string")
    made = [F.concat(F.lit("unsubscribe+"), t, F.lit("@x.org")), F.concat(F.lit("list-OPT-OUT."), t, F.lit("@x.org")), F.concat(F.lit("unsubscriber"), t, F.lit("@x.org")), F.concat(t, F.lit("@unsub.org")), F.concat(t, F.lit("@mail.unsub.shop.co.uk")), F.concat(t, F.lit("@unsubs.mail.org")), F.lit("")]
    address = made[6]
    for n in range(6):
        address = F.when(k % 7 == n, made[n]).otherwise(address)
    return table(spark, sf_dir, "customer").select("c_custkey", X.is_unsubscribe_address(address).alias("unsubscribes"))


@query("label_quality_join", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_true, count(*) FILTER (quality = 0) AS n_false, count(*) FILTER (quality IS NULL) AS n_empty FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    of = Model.from_document({"objects": {"label": {"labelField": "lang", "fields": {"lang": {"type": "TEXT"}, "good": {"type": "BOOLEAN"}}}}}).object("label")
    rows, good = joined.withColumn("good", F.col("quality") == 1), value(of, "good")
    return rows.groupBy("lang").agg(*(aggregate_column(f, good).alias(n) for f, n in (("COUNT", "n"), ("COUNT_TRUE", "n_true"), ("COUNT_FALSE", "n_false"), ("COUNT_EMPTY", "n_empty"))))


@query("text_keys", r"SELECT c_custkey, lower(trim(c_name)) AS email, regexp_replace(c_name, '\D', '', 'g') AS phone, replace(lower(c_name), '#', '-') AS kebab, lower(replace(c_name, '#', '')) AS header FROM customer")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_email(n).alias("email"), X.phone_key(n).alias("phone"), X.kebab(n).alias("kebab"), X.header_key(n).alias("header"))


@query("subject_threads", "SELECT trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS subject, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    marked = F.concat(F.when(F.col("turn") % 2 == 0, "Re: AW:  ").otherwise("Fwd[2]: "), F.col("text"))
    return c.groupBy(X.subject_key(marked).alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "event_differences",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders)
SELECT k, '.a.x' AS path, 'changed' AS op, CAST(c AS VARCHAR) AS old, CAST(c + 1 AS VARCHAR) AS new FROM o WHERE k % 2 = 1
UNION ALL SELECT k, '.a.y[' || n || ']', 'moved', '[' || m || ']', '[' || n || ']' FROM o, (VALUES (0, 2), (1, 0), (2, 1)) v(m, n) WHERE k % 3 = 0
UNION ALL SELECT k, '.a.y[1]', 'changed', '2', '9' FROM o WHERE k % 3 = 1
UNION ALL SELECT k, '.s', 'removed', '"' || s || '"', NULL FROM o WHERE k % 5 = 0
UNION ALL SELECT k, '.t', 'added', NULL, '{"deep":["' || s || '"]}' FROM o WHERE k % 5 = 1
UNION ALL SELECT k, '.l[0].q', 'changed', '"' || s || '"', 'null' FROM o WHERE k % 7 = 0
UNION ALL SELECT k, '.m', 'changed', '1', '"1"' FROM o WHERE k % 11 = 0""",
)
def event_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two nested values of each order: names, list items, moves; other spellings of a number are no change."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    t = lambda x: x.cast("string")
    before = F.concat(F.lit('{"a":{"x":'), t(c), F.lit(',"y":[1,2,3]},"n":1.0,"s":"'), s, F.lit('","l":[{"q":"'), s, F.lit('"}],"m":1}'))
    after = F.concat(
        F.lit('{"n":10e-1,"a":{"y":'), F.when(k % 3 == 0, "[2,3,1]").when(k % 3 == 1, "[1,9,3]").otherwise("[1,2.0,3]"), F.lit(',"x":'), t(F.when(k % 2 == 1, c + 1).otherwise(c)), F.lit("}"),
        F.when(k % 5 != 0, F.concat(F.lit(',"s":"'), s, F.lit('"'))).otherwise(""), F.when(k % 5 == 1, F.concat(F.lit(',"t":{"deep":["'), s, F.lit('"]}'))).otherwise(""),
        F.lit(',"l":[{"q":'), F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit('"'), s, F.lit('"'))), F.lit('}],"m":'), F.when(k % 11 == 0, '"1"').otherwise("1"), F.lit("}"),
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), before.alias("before"), after.alias("after"))
    return differences.differences(rows, "k", "before", "after")


@query(
    "log_cursor_rounds",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS happened, CASE WHEN event_id % 3 = 0 THEN 'create' ELSE 'update' END AS op, CAST(user_id AS VARCHAR) AS record_id, CASE WHEN event_id % 3 <> 0 THEN 'lead' END AS old_stage, event_type AS new_stage, CAST(1 AS BIGINT) AS n_read FROM events",
)
def log_cursor_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events appended to a log of monthly shards in two writes, and read in two rounds: up to a cursor amid each shard, and behind it."""
    e, text = table(spark, sf_dir, "events"), F.lit(None).cast("string")
    new = F.col("event_id") % 3 == 0
    log = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), F.lit("ann").alias("actor"), F.when(new, "create").otherwise("update").alias("op"), F.lit("deal").alias("object"), F.col("user_id").cast("string").alias("record_id"),
        F.create_map(F.lit("stage"), F.array(F.when(~new, "lead"), F.col("event_type"))).alias("changes"), F.struct(F.lit("cli").alias("kind"), text.alias("ref")).alias("origin"),
    )
    path = f"{shared_folder(spark)}/recordwell-log-{uuid.uuid4().hex}"
    sinks.append_events(log.where(new), path)
    sinks.append_events(log.where(~new), path)
    cursor = change_log.log_end(spark, path).select("shard", F.expr("line div 2").alias("line"))
    first = change_log.read_events(spark, path).join(cursor, "shard").where("seq <= line").drop("line")
    both = first.unionByName(change_log.read_events(spark, path, cursor), allowMissingColumns=True)
    stage = F.col("changes")["stage"]
    rows = both.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("happened"), "op", "record_id", stage.old.alias("old_stage"), stage.new.alias("new_stage"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_read"))
