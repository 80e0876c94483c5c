"""Pages, link graphs, checks, schema changes and streams over the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import shared_folder
from ..operators import front_matter, graph, pages, schema_changes
from ..schema import Field, Option
from ..sources import mail, sinks
from ..streaming import triggers
from . import crm
from .crm import MODEL, NOW, OPPORTUNITY, PRODUCT
from .registry import SQL, query, table


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown pages, their whole texts below two links to others, some of which don't exist."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    t = lambda c: c.cast("string")
    head = F.concat(F.lit("---\ntitle: Page "), t(k), F.lit("\nlang: "), F.col("lang"), F.lit("\ntags: ["), F.col("source"), F.lit(", Tag"), t(k % 3), F.lit("]\nstatus: "), F.when(k % 4 == 0, "").otherwise("active"), F.lit("\n---\n"))
    body = F.concat(F.lit("# Page\nSee [[wiki/p"), t(k + 1), F.lit("|next]] and [[wiki/p"), t(k * 2), F.lit("#top]].\n"))
    return pages.parsed(d.select(F.concat(F.lit("wiki/p"), t(k), F.lit(".md")).alias("path"), F.concat(head, body, F.coalesce("text", F.lit(""))).alias("text"), k))


@query("page_selector", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND doc_id % 4 <> 0 AND doc_id % 3 = 1")
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"kind": "filter", "conditions": [{"property": "lang", "operator": "not_equals", "value": "en"}, {"property": "lang", "operator": "not_contains", "value": "S"}, {"property": "status", "operator": "is_not_empty"}, {"property": "tags", "operator": "ends_with", "value": "Tag1"}, {"property": "__path", "operator": "in_path", "value": "wiki/"}, {"property": "tags", "operator": "is_list"}]}
    return wiki(spark, sf_dir).where(pages.selector(spec)).select("doc_id")


@query("page_bulk_edit", "SELECT doc_id, CASE WHEN lang = 'fr' THEN source || ',tag' || CAST(doc_id % 3 AS VARCHAR) || ',checked' ELSE source || ',Tag' || CAST(doc_id % 3 AS VARCHAR) END AS tags, CASE WHEN lang = 'fr' THEN 'none' ELSE lang END AS lang FROM documents")
def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = pages.selector({"kind": "filter", "conditions": [{"property": "language", "operator": "equals", "value": "fr"}]})
    out = pages.edited(wiki(spark, sf_dir), F.lit(True), {"action": "rename", "property": "lang", "to": "language"})
    out = pages.edited(out, which, {"action": "normalize_values", "property": "tags", "steps": ["trim", "lowercase"]})
    out = pages.edited(out, which, {"action": "set", "property": "tags", "value": ["checked"], "mode": "merge_list"})
    out = pages.edited(out, which, {"action": "delete", "property": "language"})
    value = lambda n: F.try_element_at("data", F.lit(n))
    return out.select("doc_id", F.array_join(value("tags"), ",").alias("tags"), F.coalesce(F.get(value("language"), F.lit(0)), F.lit("none")).alias("lang"))


@query("property_inventory", "SELECT p AS property, count(*) AS pages, CAST(count(*) FILTER (p = 'tags') AS BIGINT) AS n_lists, CAST(count(*) FILTER (p <> 'tags') AS BIGINT) AS n_scalars, CAST(sum(CASE WHEN p = 'tags' THEN 2 WHEN p = 'status' AND doc_id % 4 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_values FROM documents, (SELECT unnest(['title', 'lang', 'tags', 'status']) AS p) GROUP BY 1")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.inventory(wiki(spark, sf_dir))


_EDGES = "e AS (SELECT doc_id AS s, doc_id + 1 AS t FROM documents UNION SELECT doc_id, doc_id * 2 FROM documents), r AS (SELECT s, t, d.doc_id AS hit FROM e LEFT JOIN documents d ON d.doc_id = t)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = wiki(spark, sf_dir)
    return p, graph.resolved_edges(graph.link_edges(p), p)


@query("link_graph_nodes", f"WITH {_EDGES} SELECT 'wiki/p' || CAST(doc_id AS VARCHAR) || '.md' AS path, (SELECT count(*) FROM r WHERE s = doc_id AND hit IS NOT NULL) AS links_out, (SELECT count(*) FROM r WHERE hit = doc_id) AS links_in FROM documents")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(*_graph(spark, sf_dir))


@query("link_graph_orphans", f"WITH {_EDGES} SELECT 'wiki/p' || CAST(doc_id AS VARCHAR) || '.md' AS path FROM documents WHERE NOT EXISTS (SELECT 1 FROM r WHERE hit = doc_id AND s <> doc_id)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphan_pages(*_graph(spark, sf_dir))


@query("link_graph_broken", f"WITH {_EDGES} SELECT 'wiki/p' || CAST(s AS VARCHAR) || '.md' AS source, 'wiki/p' || CAST(t AS VARCHAR) AS target FROM r WHERE hit IS NULL")
def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.broken_links(_graph(spark, sf_dir)[1])


@query(
    "quality_findings",
    "SELECT 'duplicate-text' AS rule, md5(text) AS subject, count(*) AS n FROM documents GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unknown-label', CAST(doc_id AS VARCHAR), count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2",
)
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return graph.findings([graph.repeated(d, F.md5("text"), "duplicate-text"), graph.unknown_references(d, F.col("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "unknown-label")])


@query("records_against_model", "SELECT CAST(o_orderkey AS VARCHAR) AS crm_id, 'stage: no option' AS problem FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority: no option' FROM orders WHERE o_orderkey % 75 = 0 AND o_orderpriority <> '5-LOW'")
def against_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = crm.opportunities(spark, sf_dir).withColumns({"stage": F.when(k % 50 == 0, "?").otherwise(F.col("stage")), "priority": F.when((k % 75 == 0) & F.col("priority").isNotNull(), "?").otherwise(F.col("priority"))})
    return graph.against_model(rows, OPPORTUNITY).select("crm_id", F.explode("problems").alias("problem"))


@query("review_states", "SELECT CASE WHEN c_custkey % 7 = 0 AND c_custkey % 11 <> 0 THEN 'unknown' WHEN c_custkey % 11 = 0 THEN 'attention-needed' WHEN c_custkey % 90 < 30 THEN 'overdue' WHEN c_custkey % 90 <= 44 THEN 'due-soon' ELSE 'current' END AS state, count(*) AS n FROM customer GROUP BY 1")
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, today = F.col("c_custkey"), F.lit("2026-06-15").cast("date")
    due = F.when(k % 7 != 0, F.date_add(today, (k % 90 - 30).cast("int")))
    return table(spark, sf_dir, "customer").groupBy(pages.review_state(due, today, k % 11 == 0).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("stale_outputs", "SELECT 'p' || CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'left over' END AS state FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 7 = 0")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = F.concat(F.lit("p"), k.cast("string")).alias("path")
    built = c.where(k % 5 != 0).select(path, F.lit("a").alias("hash"))
    wanted = c.where((k % 5 == 0) | (k % 3 == 0) | (k % 7 != 0)).select(path, F.when(k % 3 == 0, "b").otherwise("a").alias("hash"))
    return graph.stale_outputs(built, wanted)


@query("option_renamed", "SELECT CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'F' ELSE o_orderstatus END AS stage, count(*) AS n, CAST(count(*) FILTER (o_orderstatus <> 'F') AS BIGINT) AS migrated FROM orders GROUP BY 1")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = schema_changes.rename_option(MODEL, "opportunity", "stage", "O", "OPEN")
    model = schema_changes.remove_option(model, "opportunity", "stage", "P", "F", used=True)
    f = model.object("opportunity").fields["stage"]
    rows = crm.opportunities(spark, sf_dir)
    log = schema_changes.migration_rows(rows, "stage", "O", "OPEN", F.lit(NOW.now)).unionByName(schema_changes.migration_rows(rows, "stage", "P", "F", F.lit(NOW.now)))
    out = schema_changes.rewritten(schema_changes.rewritten(rows, f, "O", "OPEN"), f, "P", "F")
    n = log.groupBy(F.col("record_id").alias("crm_id")).agg(F.count(F.lit(1)).alias("m"))
    return out.join(n, "crm_id", "left").groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("m", F.lit(0))).alias("migrated"))


@query("list_option_removed", "SELECT p_partkey, array_to_string(list_distinct_keep, ',') AS colors FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> 'red') AS list_distinct_keep FROM part WHERE p_partkey % 9 <> 0 AND contains(p_name, 'red'))")
def list_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = crm.products(spark, sf_dir).where(F.array_contains("colors", "red"))
    out = schema_changes.rewritten(had, PRODUCT.fields["colors"], "red", None)
    return out.select("p_partkey", F.array_join("colors", ",").alias("colors"))


@query("new_field_with_default", "SELECT 'NEW' AS state, count(*) AS n FROM customer")
def new_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Field("state", "SELECT", nullable=False, default="NEW", options=(Option("NEW"), Option("OLD")))
    schema_changes.add_field(MODEL, "company", f, live_records=1)
    return schema_changes.with_new_field(crm.companies(spark, sf_dir), f).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("export_standard_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1000000 AS BIGINT) AS VARCHAR) END AS micros, 'EUR' AS code, o_orderstatus AS stage, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV in chunks and read back."""
    path = f"{shared_folder(spark)}/recordwell-export-{uuid.uuid4().hex}"
    sinks.write_csv(crm.opportunities(spark, sf_dir), path, sinks.standard_columns(OPPORTUNITY), most_rows=4000)
    back = spark.read.option("header", True).option("lineSep", "\r\n").csv(path)
    return back.select("id", "name", F.col("`amount.amountMicros`").alias("micros"), F.col("`amount.currencyCode`").alias("code"), "stage", "priority")


@query("export_junction", "SELECT CAST(o_orderkey AS VARCHAR) AS owner, CAST(o_custkey AS VARCHAR) AS target, 36 AS id_length, count(*) OVER () AS n_ids FROM orders")
def junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.junction_rows(crm.opportunities(spark, sf_dir), OPPORTUNITY, "company", "opportunity", MODEL)
    ids = rows.agg(F.countDistinct("id").alias("n_ids"))
    return rows.select(F.col("opportunityId").alias("owner"), F.col("targetCompanyId").alias("target"), F.length("id").alias("id_length")).join(F.broadcast(ids))  # one row


@query("knowledge_graph_written", f"WITH {_EDGES} SELECT 'links' AS part, count(*) AS n FROM r WHERE hit IS NOT NULL UNION ALL SELECT 'unresolved', count(*) FROM r WHERE hit IS NULL UNION ALL SELECT 'nodes', count(*) FROM documents")
def graph_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON and read back."""
    path = f"{shared_folder(spark)}/recordwell-graph-{uuid.uuid4().hex}"
    p, edges = _graph(spark, sf_dir)
    sinks.write_graph(graph.nodes(p, edges), edges, path)
    counted = [spark.read.json(f"{path}/{part}").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")) for part in ("links", "unresolved", "nodes")]
    return graph.findings(counted)


@query("html_to_text")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", mail.html_text(F.col("html")).alias("text"))


@query("least_loaded", "SELECT CAST(c_custkey AS VARCHAR) AS candidate, count(o_orderkey) AS load FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("target_id"))
    return triggers.least_loaded(crm.companies(spark, sf_dir).select(F.col("crm_id").alias("candidate")), links)


@query("round_robin", "SELECT o_orderkey, ['ann', 'bo', 'cy'][1 + (row_number() OVER (ORDER BY o_orderkey) - 1) % 3] AS picked FROM orders")
def robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], ["ann", "bo", "cy"])


@query("session_activity", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return triggers.session_activity(e).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def _changes(e: DataFrame) -> DataFrame:
    change = F.create_map(F.lit("stage"), F.struct(F.lit(None).cast("string").alias("old"), F.col("event_type").alias("new")))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("user").alias("object"), F.when(F.col("event_type") == "signup", "create").otherwise("update").alias("op"), F.col("user_id").cast("string").alias("record_id"), F.col("ts").cast("timestamp").alias("at"), change.alias("changes"),
        F.struct(F.when(F.col("event_id") % 10 == 0, "greet").alias("workflow")).alias("origin"), F.lit(0).alias("depth"),
    )


TRIGGERS = [triggers.Trigger("greet", "user", ("create",)), triggers.Trigger("alarm", "user", ("update",), ("stage",))]


@query(
    "event_triggers_batch",
    "SELECT CASE WHEN event_type = 'signup' THEN 'greet' ELSE 'alarm' END AS workflow, count(DISTINCT (user_id, event_type)) AS n FROM events WHERE event_type <> 'signup' OR event_id % 10 <> 0 GROUP BY 1",
)
def trigger_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.runs(_changes(table(spark, sf_dir, "events")), TRIGGERS).groupBy("workflow").agg(F.count(F.lit(1)).alias("n"))


@query("stream_event_trigger", SQL["event_triggers_batch"])
def trigger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a file stream that has caught up; what it wrote is read back."""
    out = f"{shared_folder(spark)}/recordwell-stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream = triggers.runs(_changes(source), TRIGGERS, late="40 days")
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cursor").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").groupBy("workflow").agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_properties_typed",
    """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, lang, source, text FROM documents)
SELECT doc_id, 'Page ' || k || ': ' || coalesce(lang, '') AS title, doc_id AS n, k AS code, CAST(doc_id + 0.5 AS DOUBLE) AS ratio, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 2 = 0 END AS flag, TRUE AS checked, coalesce(source, '') || '|x, y|' || CAST(doc_id % 3 AS VARCHAR) AS tags, 'it''s|' || k AS notes, 'BIGINT STRING VOID' AS kinds, sha256(coalesce(text, '')) AS body_sha256, 0 AS n_problems FROM d""",
)
def properties_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as pages: their typed properties read, one set and one taken away, written as text and read again."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    k, none = n.cast("string"), F.lit("")
    lines = [
        F.concat(F.lit('# page\ntitle: "Page '), k, F.lit(": "), F.coalesce("lang", none), F.lit('"')), F.concat(F.lit("n: "), k), F.concat(F.lit('code: "'), k, F.lit('"')), F.concat(F.lit("ratio: "), k, F.lit(".5")), F.concat(F.lit("flag: "), F.when(n % 2 == 0, "True").otherwise("false")),
        F.concat(F.lit("gone: ~\ntags: ['"), F.coalesce("source", none), F.lit("', \"x, y\", "), (n % 3).cast("string"), F.lit("]")), F.concat(F.lit("notes:\n  - 'it''s'\n  # a comment\n  - "), k),
    ]
    page = F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---\n"), F.coalesce("text", none))
    read = front_matter.typed(d.select("doc_id", page.alias("text")))
    data = front_matter.put(F.when(n % 4 == 0, front_matter.put(F.col("data"), "flag", None)).otherwise(F.col("data")), "checked", F.lit(True).cast("variant"))
    again = front_matter.typed(read.select("doc_id", F.concat(front_matter.head_text(data, F.col("comments")), "body").alias("text")))
    of = lambda name: F.try_element_at("data", F.lit(name))
    texts = lambda name: F.array_join(of(name).cast("array<string>"), "|")
    return again.select(
        "doc_id", of("title").cast("string").alias("title"), of("n").cast("bigint").alias("n"), of("code").cast("string").alias("code"), of("ratio").cast("double").alias("ratio"), of("flag").cast("boolean").alias("flag"), of("checked").cast("boolean").alias("checked"),
        texts("tags").alias("tags"), texts("notes").alias("notes"), F.concat_ws(" ", *(F.schema_of_variant(of(x)) for x in ("n", "code", "gone"))).alias("kinds"), F.sha2("body", 256).alias("body_sha256"), F.size("problems").alias("n_problems"),
    )
