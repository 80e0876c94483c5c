"""Shapes, orders and labels of records, and what people may do with them, over the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import shared_folder
from ..functions import text as X
from ..functions.dates import GRAINS, bucket, bucket_label
from ..functions.values import display, files_items, json_list, title, value
from ..functions.zones import zone_name
from ..operators import aggregates, permissions, projection, relations, search
from ..schema import Model
from ..sources import kinds, sinks
from . import crm
from .crm import COMPANY, NOW, OPPORTUNITY
from .record_queries import CODE, OPP
from .registry import query, table

_GROUPS = f"WITH {OPP}, g AS (SELECT coalesce(priority, '') AS k, CAST(sum(amount) AS DECIMAL(38,6)) AS v FROM opp GROUP BY 1), o AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-NEVER']) AS k, unnest([0,1,2,3,4,5]) AS p), x AS (SELECT coalesce(o.k, g.k) AS k, coalesce(v, 0) AS v, p FROM o FULL JOIN g ON o.k = g.k)"
_WAYS = {"value": "v DESC NULLS LAST, k = '', p, k", "value_asc": "v ASC NULLS LAST, k = '', p, k", "position": "k = '', p, k", "position_desc": "k = '', p DESC, k DESC", "label": "k = '', p, k", "label_desc": "k = '', p DESC, k DESC"}
_ORDERED = " UNION ALL ".join(f"SELECT '{way}' AS way, k AS group_key, row_number() OVER (ORDER BY {keys}) AS place FROM x" for way, keys in _WAYS.items())


@query("chart_ordering", f"{_GROUPS} {_ORDERED}")
def chart_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each of a chart's groups in all six orders; a few groups, so one task numbers them."""
    from pyspark.sql import Window

    out = aggregates.grouped(crm.opportunities(spark, sf_dir), OPPORTUNITY, "SUM", "amount", "priority")
    places = [F.struct(F.lit(way).alias("way"), F.row_number().over(Window.partitionBy(F.lit(way)).orderBy(*aggregates.chart_order(out, OPPORTUNITY, "priority", way))).cast("long").alias("place")) for way in _WAYS]
    return out.withColumns({f"p{k}": p for k, p in enumerate(places)}).select("group_key", F.explode(F.array(*(f"p{k}" for k in range(len(places))))).alias("p")).select("p.way", "group_key", "p.place")


@query(
    "empty_sum_in_default_currency",
    f"""WITH {OPP}, x AS (SELECT opp.*, {CODE} AS currency FROM opp JOIN customer n ON o_custkey = c_custkey), y AS (SELECT *, o_orderkey % 11 = 0 AS none FROM x)
SELECT none, currency, CAST(sum(amount) AS DECIMAL(38,6)) AS value, count(*) AS n FROM y WHERE amount IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT DISTINCT none, 'EUR', CAST(0 AS DECIMAL(38,6)), 0 FROM y WHERE none""",
)
def empty_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crm.opportunities(spark, sf_dir, with_company=True)
    out = aggregates.money_totals(rows, OPPORTUNITY, "amount", "EUR", [F.col("o_orderkey") % 11 == 0])
    return out.select(F.col("g0").alias("none"), "currency", "value", "n")


_LABEL = {
    "DAY": "strftime(d, '%d.%m.%Y')", "WEEK": "'Week ' || CAST(CAST(strftime(d, '%V') AS INTEGER) AS VARCHAR) || ' ' || strftime(d, '%G')", "MONTH": "strftime(d, '%b %Y')", "QUARTER": "'Q' || CAST(quarter(d) AS VARCHAR) || ' ' || CAST(year(d) AS VARCHAR)", "YEAR": "CAST(year(d) AS VARCHAR)",
    "DAY_OF_WEEK": "strftime(d, '%a')", "MONTH_OF_YEAR": "strftime(d, '%B')", "QUARTER_OF_YEAR": "'Q' || CAST(quarter(d) AS VARCHAR)",
}


@query("bucket_labels", "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) " + " UNION ALL ".join(f"SELECT '{g}' AS grain, {sql} AS label, count(*) AS n FROM x GROUP BY 2" for g, sql in _LABEL.items()))
def bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are counted first, so labels are made once a day and grain."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*(F.struct(F.lit(g).alias("grain"), bucket_label(bucket(F.col("d"), g), g).alias("label")) for g in GRAINS))
    return days.select("n", F.explode(labels).alias("x")).groupBy("x.grain", "x.label").agg(F.sum("n").alias("n"))


@query("group_labels", f"WITH {OPP} SELECT coalesce(c_name, '') AS company, CASE WHEN stage = 'F' THEN 'Finished' WHEN stage = 'O' THEN 'Open' ELSE stage END AS stage, count(*) AS n FROM opp LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by key, then named: options by their label, links by the current title of their record."""
    model = Model.from_document({"objects": {"deal": {"labelField": "stage", "fields": {"stage": {"type": "SELECT", "options": [{"value": "F", "label": "Finished"}, {"value": "O", "label": "Open"}, {"value": "P"}]}}}}})
    groups = crm.opportunities(spark, sf_dir).groupBy("company", "stage").agg(F.count(F.lit(1)).alias("n"))
    named = relations.with_titles(groups, "company", crm.companies(spark, sf_dir), "company")
    return named.select(F.coalesce("company_now.title", F.lit("")).alias("company"), display(model.object("deal"), "stage").alias("stage"), "n")


@query(
    "shaped_rows",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, 'company' AS object, c_name AS title, 'records/company/' || CAST(c_custkey AS VARCHAR) || '.md' AS path, false AS deleted, 'name,segment,balance,nation' AS fields, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS segment, '\"' || c_name || '\"' AS raw_name FROM customer",
)
def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.shaped(crm.companies(spark, sf_dir), COMPANY)
    v = F.col("values")
    return rows.select("id", "object", "title", "path", "deleted", F.array_join(F.map_keys(v), ",").alias("fields"), v["segment"].display.alias("segment"), v["name"].raw.alias("raw_name"))


@query("expanded_relations", "SELECT CAST(o_orderkey AS VARCHAR) AS crm_id, c_name AS company, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 6 <> 0) ON o_custkey = c_custkey")
def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = crm.companies(spark, sf_dir).withColumn("crm_deleted_at", F.when(F.col("c_custkey") % 6 == 0, F.lit("2020-01-01").cast("timestamp")))
    out = relations.expanded(crm.opportunities(spark, sf_dir), {"company": ("company", companies)}, {"company": ["segment"]})
    return out.select("crm_id", F.col("company_record.crm_title").alias("company"), F.col("company_record.segment").alias("segment"))


@query("titles_derived", f"WITH {OPP} SELECT CAST(o_orderkey AS VARCHAR) AS crm_id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, CAST(CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(38,2)) AS amount FROM orders")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.opportunities(spark, sf_dir).select("crm_id", title(OPPORTUNITY).alias("title"), value(OPPORTUNITY, "amount").column.cast("decimal(38,2)").alias("amount"))


ROLES = {"roles": {"sales": {"objects": {"company": {"read": True, "update": True, "fields": {"balance": {"update": False}}}, "*": {"read": True}}}, "admin": {"objects": {"*": {"read": True, "update": True, "delete": True}}}}, "assignments": {"user:7": "admin", "user:1*": "sales"}, "default_role": None}


@query(
    "permission_checks",
    """WITH o AS (SELECT event_id, 'user:' || CAST(user_id AS VARCHAR) AS actor, CASE event_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'person' ELSE 'company' END AS object, CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'create' WHEN 2 THEN 'update' ELSE 'destroy' END AS action, CASE WHEN event_id % 5 = 0 THEN 'balance' END AS field FROM events)
SELECT event_id, CASE WHEN actor = 'user:7' THEN CASE WHEN action = 'destroy' THEN 'action' END WHEN actor LIKE 'user:1%' THEN CASE WHEN object = 'company' THEN CASE WHEN action = 'destroy' THEN 'action' WHEN action <> 'read' AND field IS NOT NULL THEN 'field' END WHEN action <> 'read' THEN 'action' END END AS refused FROM o""",
)
def permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    planned = e.select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor"), F.when(k % 3 == 1, "person").otherwise("company").alias("object"), F.when(k % 4 == 0, "read").when(k % 4 == 1, "create").when(k % 4 == 2, "update").otherwise("destroy").alias("action"), F.when(k % 5 == 0, "balance").alias("field"))
    return permissions.checked(planned, ROLES).select("event_id", "refused")


@query("person_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Max' WHEN c_custkey % 3 = 1 THEN 'Anna' ELSE 'Eva' END AS first, CASE WHEN c_custkey % 3 = 0 THEN 'Müller' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'Maria R' || CAST(c_custkey AS VARCHAR) ELSE 'Berg' || CAST(c_custkey AS VARCHAR) END AS last FROM customer")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    shown = F.when(k % 3 == 0, F.concat(F.lit('"Müller'), t, F.lit(', Max"'))).when(k % 3 == 1, F.concat(F.lit("anna  Maria R"), t, F.lit(": Sales")))
    address = F.concat(F.lit("eva.berg"), t, F.lit("+news@x.org"))
    name = X.person_name(shown, address)
    return table(spark, sf_dir, "customer").select("c_custkey", name.firstName.alias("first"), name.lastName.alias("last"))


@query("top_claims", """WITH c AS (SELECT doc_id // 20 AS page, doc_id, text, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), s AS (SELECT *, CAST(list_contains(w, 'ering') AS INTEGER) + CAST(list_contains(w, 'the') AS INTEGER) + CAST(list_contains(w, 'der') AS INTEGER) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, CAST(doc_id AS VARCHAR)) AS k, max(n) OVER (PARTITION BY page) AS most FROM s) SELECT page, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FILTER (n > 0 AND k <= 8), '') AS claims FROM r GROUP BY page""")
def top_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of twenty documents each, their texts as claims."""
    d = table(spark, sf_dir, "documents")
    pages = d.groupBy(F.floor(F.col("doc_id") / 20).alias("page")).agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.lit("done").alias("status"))).alias("claims"))
    return search.relevant_claims(pages, "the ering der").select("page", F.array_join(F.transform("top_claims", lambda c: c.id), ",").alias("claims"))


@query("distinct_members", "SELECT l_suppkey % 10 AS widget, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def distinct_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that stands in several of a widget's groups counts once."""
    groups = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("widget"), F.col("l_suppkey").alias("group"), F.col("l_partkey").cast("string").alias("crm_id"))
    return aggregates.distinct_members(groups, ["widget"]).groupBy("widget").agg(F.count(F.lit(1)).alias("n"))


@query("json_lists", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a,7' WHEN s_suppkey % 3 = 1 THEN '' ELSE '{\"name\":\"x\"},b' END AS items, CASE WHEN s_suppkey % 3 = 2 THEN 'x' ELSE '' END AS files FROM supplier")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, '["a", 7]').when(k % 3 == 1, '{"a": [1]}').otherwise('[{"name":"x"}, "b"]')
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(json_list(text), ",").alias("items"), F.array_join(F.transform(files_items(text), lambda f: f.getField("name")), ",").alias("files"))


@query(
    "zone_names",
    "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Tokyo' WHEN 3 THEN '+02:00' WHEN 4 THEN '+01:00' ELSE 'UTC' END AS zone, strftime(TIMESTAMP '2026-07-01 00:00:00' + INTERVAL 1 MINUTE * CASE c_custkey % 6 WHEN 0 THEN 120 WHEN 1 THEN -240 WHEN 2 THEN 540 WHEN 3 THEN 120 WHEN 4 THEN 60 ELSE 0 END, '%H:%M') AS local FROM customer",
)
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    written = F.when(k == 0, "/mozilla.org/20070129_1/Europe/Berlin").when(k == 1, "Eastern Standard Time").when(k == 2, '"Tokyo Standard Time"').when(k == 3, "GMT+0200").when(k == 4, "Our own zone").otherwise("nowhere")
    zone = zone_name(written, F.when(k == 4, "+0100"))
    return table(spark, sf_dir, "customer").select("c_custkey", zone.alias("zone")).select("c_custkey", "zone", F.date_format(F.from_utc_timestamp(F.lit("2026-07-01 00:00:00").cast("timestamp"), F.col("zone")), "HH:mm").alias("local"))


@query("file_kinds", "SELECT 'table' AS reader, CASE WHEN page_id % 4 = 0 THEN 'json' WHEN page_id % 4 = 1 THEN 'html' WHEN page_id % 4 = 2 THEN 'pdf' ELSE 'csv' END AS kind, count(*) AS n FROM pages GROUP BY 2 UNION ALL SELECT 'mail', CASE WHEN page_id % 4 = 0 THEN 'eml' WHEN page_id % 4 = 1 THEN 'unknown' WHEN page_id % 4 = 2 THEN 'ics' ELSE 'mbox' END, count(*) FROM pages GROUP BY 2")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    p = table(spark, sf_dir, "pages").select("html", k.alias("k"))
    tables = F.when(F.col("k") == 0, F.concat(F.lit('[{"a": "'), "html")).when(F.col("k") == 1, F.concat(F.lit("<!DOCTYPE html>"), "html")).when(F.col("k") == 2, F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.concat(F.lit("a;b\n"), "html"))
    mails = F.when(F.col("k") == 0, F.concat(F.lit("Subject: x\n\n"), "html")).when(F.col("k") == 1, "html").when(F.col("k") == 2, F.concat(F.lit("BEGIN:VCALENDAR\n"), "html")).otherwise(F.concat(F.lit("From x@y Mon\n"), "html"))
    html = lambda c: F.encode(c, "UTF-8")
    plain = F.when(F.col("k") == 1, F.lit("no head at all")).otherwise(mails)
    kinds_ = F.array(F.struct(F.lit("table").alias("reader"), kinds.table_kind(html(tables), F.lit("x")).alias("kind")), F.struct(F.lit("mail").alias("reader"), kinds.mail_kind(html(plain), F.lit("x")).alias("kind")))
    return p.select(F.explode(kinds_).alias("x")).groupBy("x.reader", "x.kind").agg(F.count(F.lit(1)).alias("n"))


@query("record_files_written", "SELECT 'records/company/' || CAST(c_custkey AS VARCHAR) || '.md' AS path, '---' || chr(10) || 'crm_id: ' || CAST(c_custkey AS VARCHAR) || chr(10) || 'crm_title: \"' || c_name || '\"' || chr(10) || 'name: \"' || c_name || '\"' || CASE WHEN c_custkey % 7 <> 0 THEN chr(10) || 'segment: ' || c_mktsegment ELSE '' END || chr(10) || 'source: import' || chr(10) || '---' || chr(10) || 'Body' AS text FROM customer")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back."""
    path = f"{shared_folder(spark)}/recordwell-files-{uuid.uuid4().hex}"
    rows = COMPANY.without("balance").without("nation").conform(crm.companies(spark, sf_dir).select("crm_id", "crm_title", "name", "segment"))
    sinks.write_records(rows.withColumns({"extra": F.create_map(F.lit("source"), F.lit("import")), "body": F.lit("Body")}), path, COMPANY.without("balance").without("nation"))
    return spark.read.parquet(path)


@query("filter_at_me", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 7 <> 0")
def at_me(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from ..operators.filters import matching

    me = replace(NOW, me="building")
    return matching(crm.companies(spark, sf_dir), COMPANY, {"field": "segment", "operand": "IS", "value": "@me"}, me).select("c_custkey")
