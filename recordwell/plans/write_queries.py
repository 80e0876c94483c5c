"""Formulas, imports, recurrences and writes over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import Context
from ..deploy import ensure_checkpoint
from ..functions import numbers as N
from ..functions.dates import parse_day
from ..functions.formula import compile_many
from ..functions.recurrence import cron_slots, occurrences
from ..operators import changes, importing, relations, transactions
from . import crm
from .crm import MODEL
from .registry import query, spread, table

AT = Context.at("2026-10-20T09:00:00Z", "Europe/Berlin")


def _stamp():
    return F.lit("2026-10-20 09:00:00").cast("timestamp")


@query(
    "formula_columns",
    """SELECT l_orderkey, l_linenumber, CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(38,4)), 2) AS DECIMAL(38,2)) AS net,
 CASE WHEN l_quantity >= 30 AND l_returnflag <> 'R' THEN 'large' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'small' END AS size,
 upper(l_returnflag) || '-' || CAST(l_linenumber AS VARCHAR) AS code, date_diff('day', CAST(l_shipdate AS DATE), DATE '2026-10-20') AS age, l_linestatus IN ('F', 'X') AS finished FROM lineitem""",
)
def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")), "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    made = compile_many(
        {
            "net": "round(l_extendedprice * (1 - l_discount), 2)",
            "size": "'large' if l_quantity >= 30 and l_returnflag != 'R' else if_(l_returnflag == 'R', 'returned', 'small')",
            "code": "concat(upper(l_returnflag), '-', l_linenumber)",
            "age": "days_between(l_shipdate, today())",
            "finished": "l_linestatus in ['F', 'X']",
        },
        dict(rows.dtypes),
        AT,
    )
    return rows.select("l_orderkey", "l_linenumber", made["net"].cast("decimal(38,2)").alias("net"), made["size"].alias("size"), made["code"].alias("code"), made["age"].cast("long").alias("age"), made["finished"].alias("finished"))


@query(
    "import_normalize_decimal_date",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS price, CASE WHEN l_linenumber % 2 = 0 THEN 'EUR' ELSE 'CHF' END AS code,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day, CASE WHEN l_linenumber = 7 THEN 'date' END AS date_rule, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS returned FROM lineitem""",
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag"))
    grouped = F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), ",.", ".,")
    money = F.when(F.col("l_linenumber") % 2 == 0, F.concat(grouped, F.lit(" €"))).otherwise(F.concat(F.lit("CHF "), grouped))
    day = F.when(F.col("l_linenumber") == 7, "soon").when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "dd.MM.yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    flag = F.when(F.col("l_returnflag") == "R", " Ja ").when(F.col("l_returnflag") == "A", "falsch")
    p, d = F.col("p"), F.col("d")
    # The cells of a table are columns: each text is made once, not once for each test on it.
    texts = rows.select("l_orderkey", "l_linenumber", money.alias("money"), day.alias("day"), flag.alias("flag"))
    cells = texts.select("l_orderkey", "l_linenumber", N.parse_money(F.col("money"), ",").alias("p"), parse_day(F.col("day")).alias("d"), N.parse_bool(F.col("flag")).flag.alias("returned"))
    return cells.select("l_orderkey", "l_linenumber", (p.amountMicros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,10)").alias("price"), p.currencyCode.alias("code"), d.day.alias("day"), d.rule.alias("date_rule"), "returned")


@query(
    "import_row_errors",
    "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'stage:select-option' WHEN o_orderkey % 10 = 1 THEN 'amount:currency' ELSE '' END AS problem, count(*) AS n FROM orders GROUP BY 1",
)
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    text = o.select(F.col("o_orderkey").alias("row_no"), F.when(k == 0, "?").otherwise(F.lower("o_orderstatus")).alias("stage"), F.when(k == 1, "12,x").otherwise(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" EUR"))).alias("amount"))
    made = importing.coerced(text, crm.OPPORTUNITY, {"stage": "stage", "amount": "amount"})
    problem = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e.column, e.rule)), ",")
    return made.groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicates_conflicting",
    """WITH g AS (SELECT md5(text) AS k, min(doc_id) AS f, count(*) AS n, count(DISTINCT lang || '/' || source) AS d FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN n > 1 AND d > 1 THEN 'duplicate-in-file' WHEN n > 1 AND doc_id > f THEN 'duplicate-ignored' END AS duplicate FROM documents JOIN g ON md5(text) = k""",
)
def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts are the key; rows of one text differ where their language or source does."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_no"), F.md5("text").alias("k"), "lang", "source")
    return importing.file_duplicates(docs, "k", ["lang", "source"]).select(F.col("row_no").alias("doc_id"), "duplicate")


@query(
    "import_match_actions",
    """WITH r AS (SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1000000 ELSE 0 END END AS k FROM orders),
t AS (SELECT c_custkey // 1 AS k, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS trash FROM customer UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey % 10 = 3),
m AS (SELECT k, count(*) AS n, count(*) FILTER (trash = 0) AS live FROM t GROUP BY 1)
SELECT CASE WHEN r.k IS NULL THEN 'create' WHEN coalesce(n, 0) > 1 THEN 'match-conflict' WHEN n IS NULL THEN 'create' WHEN live = 0 THEN 'restore' ELSE 'update' END AS action, count(*) AS n FROM r LEFT JOIN m ON r.k = m.k GROUP BY 1""",
)
def match_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey") + F.when(F.col("o_orderkey") % 17 == 0, 1_000_000).otherwise(0))
    first = c.select(F.col("c_custkey").cast("string").alias("crm_id"), F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 == 0, _stamp()).alias("crm_deleted_at"))
    again = c.where("c_custkey % 10 = 3").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("crm_id"), F.col("c_custkey").alias("key"), F.lit(None).cast("timestamp").alias("crm_deleted_at"))
    found = importing.matched(o.select(F.col("o_orderkey").alias("row_no"), key.alias("k")), first.unionByName(again), "k", "key")
    return found.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "campaign_audience",
    """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'u' || CAST(c_custkey % 1000 AS VARCHAR) || '@' || CASE c_custkey % 3 WHEN 0 THEN 'a.example.org' ELSE 'b.example.com' END END AS email, c_custkey % 23 = 0 AS deleted, c_custkey % 5 <> 0 AS subscribed FROM customer),
e AS (SELECT *, CASE WHEN deleted THEN 'person_deleted' WHEN NOT subscribed THEN 'not_subscribed' WHEN email = '' THEN 'no_email' END AS early FROM p), f AS (SELECT email, min(id) AS first_id FROM e WHERE early IS NULL GROUP BY 1)
SELECT coalesce(CASE WHEN early IS NOT NULL THEN early WHEN id > first_id THEN 'duplicate_address' WHEN e.email LIKE '%@a.example.org' THEN 'blocklisted' WHEN substr(e.email, 2, 1) = '7' THEN 'suppressed_bounce' WHEN id % 2 = 0 THEN 'auto_created' END, 'sent') AS reason, count(*) AS n FROM e LEFT JOIN f ON e.email = f.email GROUP BY 1""",
)
def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    address = lambda n, h: F.concat(F.lit("u"), n.cast("string"), F.lit("@"), h)
    people = c.select(k.alias("person_id"), k.alias("position"), F.when(k % 19 == 0, "").otherwise(address(k % 1000, F.when(k % 3 == 0, "A.example.org").otherwise("b.example.com"))).alias("email"), (k % 23 == 0).alias("deleted"), (k % 5 != 0).alias("subscribed"), (k % 2 == 0).alias("auto_created"))
    sent = c.where("substr(cast(c_custkey % 1000 as string), 1, 1) = '7'").select(address(k % 1000, F.lit("b.example.com")).alias("address"))
    suppressed = sent.withColumn("reason", F.lit("UNSUBSCRIBE")).union(sent.withColumn("reason", F.lit("BOUNCE")))
    return importing.audience(people, suppressed, F.array(F.lit("example.org"))).groupBy(F.coalesce("reason", F.lit("sent")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _upsert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    k = F.col("c_custkey")
    records = c.select(k, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(k % 9 == 0, F.lit("2020-01-01").cast("timestamp")).alias("crm_deleted_at"), F.lit("2020-01-01").cast("timestamp").alias("crm_updated_at"))
    rows = s.select((F.col("s_suppkey") * 20).alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return changes.upsert(records, rows, "c_custkey", ["name", "segment"], _stamp())


_ROWS = "r AS (SELECT s_suppkey * 20 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier)"


@query(
    "upsert_change_capture",
    f"WITH {_ROWS} SELECT r.k AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'create' WHEN c_custkey % 9 = 0 THEN 'restore' ELSE 'update' END AS op, CASE WHEN name IS NOT NULL THEN coalesce(c_name, '-') || '>' || name ELSE '' END AS renamed FROM r LEFT JOIN customer ON c_custkey = r.k WHERE c_custkey IS NULL OR c_custkey % 9 = 0 OR name IS NOT NULL",
)
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.try_element_at("changes", F.lit("name"))
    return _upsert(spark, sf_dir)[1].select("c_custkey", "op", F.when(c.isNotNull(), F.concat(F.coalesce(c.old, F.lit("-")), F.lit(">"), c.new)).otherwise("").alias("renamed"))


@query(
    "upsert_next_version",
    f"WITH {_ROWS} SELECT coalesce(c_custkey, r.k) AS c_custkey, coalesce(r.name, c_name) AS name, c_mktsegment AS segment, (c_custkey % 9 = 0 AND r.k IS NULL) IS TRUE AS deleted FROM customer FULL JOIN r ON c_custkey = r.k",
)
def upsert_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir)[0].select("c_custkey", "name", "segment", F.col("crm_deleted_at").isNotNull().alias("deleted"))


@query("soft_delete_restore", "SELECT c_mktsegment AS segment, count(*) FILTER (c_custkey % 4 = 0 AND c_custkey % 8 <> 0) AS deleted, count(*) FILTER (c_custkey % 4 <> 0 OR c_custkey % 8 = 0) AS live FROM customer GROUP BY 1")
def delete_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumns({"crm_deleted_at": F.lit(None).cast("timestamp"), "crm_updated_at": F.lit(None).cast("timestamp")})
    out = changes.restore(changes.delete(c, F.col("c_custkey") % 4 == 0, _stamp()), F.col("c_custkey") % 8 == 0, _stamp())
    return out.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("crm_deleted_at").alias("deleted"), F.count_if(F.col("crm_deleted_at").isNull()).alias("live"))


@query(
    "merge_records",
    """WITH g AS (SELECT c_custkey // 5 AS g, c_custkey, c_custkey % 5 AS rank, CASE WHEN c_custkey % 5 > 1 THEN c_mktsegment END AS segment, c_name FROM customer)
SELECT min(c_custkey) AS c_custkey, min_by(c_name, rank) AS name, min_by(segment, rank) FILTER (segment IS NOT NULL) AS segment, count(*) AS n_tags FROM g GROUP BY g""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(k, F.col("c_name").alias("name"), F.when(k % 5 > 1, F.col("c_mktsegment")).alias("segment"), F.array(k.cast("string")).alias("tags"))
    groups = records.select(F.floor(k / 5).alias("group_id"), "c_custkey", (k % 5 + 1).alias("rank"))
    return changes.merge(records, groups, "c_custkey", ["name", "segment"], ["tags"])[0].select("c_custkey", "name", "segment", F.size("tags").cast("long").alias("n_tags"))


@query(
    "merge_with_preferences",
    """WITH g AS (SELECT c_custkey // 4 AS g, c_custkey, c_custkey % 4 AS rank, c_name, c_mktsegment FROM customer)
SELECT min(c_custkey) AS c_custkey, min_by(c_name, CASE WHEN rank = 2 THEN -1 ELSE rank END) AS name, array_to_string(list_distinct(list(c_mktsegment ORDER BY rank)), ' ') IS NOT NULL AS joined, count(DISTINCT c_mktsegment) AS n_texts FROM g GROUP BY g""",
)
def merged_by_wish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of each four decides the name; their segments are joined, each once."""
    k = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(k, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    groups = records.select(F.floor(k / 4).alias("group_id"), "c_custkey", (k % 4 + 1).alias("rank"), F.when(k % 4 == 2, F.array(F.lit("name"))).alias("wins"))
    out = changes.merge(records, groups, "c_custkey", ["name"], texts=["note"])[0]
    return out.select("c_custkey", "name", F.col("note").isNotNull().alias("joined"), F.size(F.split("note", "\n\n")).cast("long").alias("n_texts"))


@query("erase_everywhere", "SELECT 'company' AS part, count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS told FROM customer WHERE c_custkey % 50 <> 3 UNION ALL SELECT 'events', count(*), 0 FROM events WHERE user_id % 50 <> 3")
def erased_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth record goes with its events; a name in other records' notes becomes a mark."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    tables = {"company": c.select(k.alias("id"), F.when(k % 2 == 0, "knows Ann Roth").otherwise("alone").alias("note")), "events": table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("note"))}
    gone = c.where(k % 50 == 3).select(k.alias("id")).union(table(spark, sf_dir, "events").where("user_id % 50 = 3").select("user_id"))
    out = changes.erase_everywhere(tables, gone, {"company": "id", "events": "id"}, {"company": ["note"]}, ["ann roth"])
    parts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("note").contains("[erased]")).alias("told")) for name, df in out.items()]
    return parts[0].unionByName(parts[1])


@query("merge_repoints_links", "SELECT o_custkey // 5 * 5 AS c_custkey, count(*) AS n FROM orders GROUP BY 1")
def repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    groups = c.select(F.floor(F.col("c_custkey") / 5).alias("group_id"), "c_custkey", (F.col("c_custkey") % 5 + 1).alias("rank"))
    _, ids = changes.merge(c, groups, "c_custkey", ["name"])
    out = changes.repointed(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", ids)
    return out.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("cascade_null", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def cascade_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return changes.cleared_links(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query(
    "cascade_destroy",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'company' AS object, 'DESTROY' AS action, count(*) AS n FROM c UNION ALL SELECT 'opportunity', 'DESTROY', count(*) FROM o UNION ALL SELECT 'item', 'SET_NULL', count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
)
def cascade_destroy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint(spark)
    first = relations.edges(MODEL, {"opportunity": crm.opportunities(spark, sf_dir)})
    item = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    second = table(spark, sf_dir, "lineitem").select(F.lit("item").alias("source_object"), F.lit("order").alias("field"), item.alias("source_id"), F.lit("opportunity").alias("target_object"), F.col("l_orderkey").cast("string").alias("target_id"))
    start = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("company").alias("object"), F.col("c_custkey").cast("string").alias("id"))
    out = relations.cascade(start, first.unionByName(second), {("opportunity", "company"): "CASCADE", ("item", "order"): "SET_NULL"})
    return out.groupBy("object", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "erase_listed",
    "SELECT o_orderkey, sha256('Order ' || CAST(o_orderkey AS VARCHAR) || ' for ' || CASE WHEN c_custkey % 3 = 0 THEN '[erased]' ELSE upper(c_name) END || ', see c' || CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) || '@x.org' ELSE '[erased]' END) AS note FROM (SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey)",
)
def erased_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of every third customer and two thirds of the mail addresses, out of a note an order."""
    customer, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    address = F.concat(k.cast("string"), F.lit("@x.org"))
    gone = customer.select(F.explode(F.array(F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 != 1, F.concat(F.lit("see C"), address)))).alias("identifier"))
    note = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" for "), F.upper("c_name"), F.lit(", see c"), address)
    notes = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == k).select("o_orderkey", note.alias("note"))
    out = changes.erase_listed(notes, "o_orderkey", ["note"], gone)
    return out.select("o_orderkey", F.sha2(F.replace("note", F.lit(", [erased]"), F.lit(", see c[erased]")), 256).alias("note"))


@query("erase_identifiers", "SELECT c_custkey, CASE WHEN c_custkey IN (5, 17, 100) THEN 'Dear [erased]!' ELSE 'Dear ' || upper(c_name) || '!' END AS note FROM customer")
def erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Dear "), F.upper("c_name"), F.lit("!")).alias("note"))
    return changes.erase(notes, ["note"], [f"Customer#{k:09d}" for k in (5, 17, 100)])


@query(
    "rrule_expand",
    """WITH c AS (SELECT s_suppkey, DATE '2026-01-05' + CAST(s_suppkey % 7 AS INTEGER) AS d0 FROM supplier), d AS (SELECT s_suppkey, d0, CAST(d0 + CAST(k AS INTEGER) AS DATE) AS d FROM c, generate_series(0, 360) t(k)),
h AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d) AS n FROM d WHERE d = d0 OR ((date_diff('day', DATE '2026-01-05', CAST(date_trunc('week', d) AS DATE)) - date_diff('day', DATE '2026-01-05', CAST(date_trunc('week', d0) AS DATE))) % 14 = 0 AND isodow(d) IN (1, 4)))
SELECT s_suppkey, n, strftime(timezone('UTC', timezone('Europe/Berlin', CAST(d AS TIMESTAMP) + INTERVAL 10 HOUR)), '%Y-%m-%d %H:%M') AS starts FROM h WHERE n <= 12""",
)
def rrule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.date_add(F.lit("2026-01-05").cast("date"), (F.col("s_suppkey") % 7).cast("int")).alias("day"))
    start = F.concat(F.col("day").cast("string"), F.lit(" 10:00:00")).cast("timestamp_ntz")
    found = occurrences("FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TH;COUNT=12", start, "Europe/Berlin", F.lit("2026-12-31").cast("date"))
    return s.select("s_suppkey", F.posexplode(found).alias("k", "t")).select("s_suppkey", (F.col("k") + 1).cast("long").alias("n"), F.date_format("t", "yyyy-MM-dd HH:mm").alias("starts"))


@query(
    "cron_slots",
    """WITH m AS (SELECT r_regionkey, TIMESTAMP '2026-01-01 07:03:00' + INTERVAL 1 MINUTE * CAST(k AS INTEGER) + INTERVAL 1 DAY * r_regionkey AS t FROM region, generate_series(0, 28000) g(k))
SELECT r_regionkey, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M') AS first_slot FROM m WHERE t > TIMESTAMP '2026-01-01 07:03:00' + INTERVAL 1 DAY * r_regionkey AND t <= TIMESTAMP '2026-01-20 18:00:00' AND minute(t) IN (0, 20, 40) AND hour(t) BETWEEN 8 AND 12 AND (day(t) = 13 OR isodow(t) = 5) GROUP BY 1""",
)
def cron(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lit("2026-01-01 07:03:00").cast("timestamp") + F.make_interval(days=F.col("r_regionkey"))
    slots = cron_slots("*/20 8-12 13 * fri", after, F.lit("2026-01-20 18:00:00").cast("timestamp"))
    return table(spark, sf_dir, "region").select("r_regionkey", slots.alias("s")).select("r_regionkey", F.size("s").cast("long").alias("n"), F.date_format(F.get("s", F.lit(0)), "yyyy-MM-dd HH:mm").alias("first_slot"))


@query("replay_changes", "SELECT user_id AS k, last(event_type ORDER BY ts, event_id) AS stage, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("at"), F.create_map(F.lit("stage"), F.struct(F.lit(None).cast("string").alias("old"), F.col("event_type").alias("new"))).alias("changes"))
    base = e.groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(None).cast("string"))
    out = changes.replayed(base.select("k", "stage"), log, "k", ["stage"])
    return out.join(base.select("k", "n"), "k")


@query(
    "transactions_decided",
    """WITH t AS (SELECT o_orderkey AS txn, o_custkey AS k, o_orderkey % 6 = 0 OR (o_orderkey % 35 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) AND o_orderkey % 35 <> 0 AS old FROM orders)
SELECT txn, CASE WHEN old THEN 'stale' WHEN row_number() OVER (PARTITION BY k, old ORDER BY txn) = 1 THEN 'accepted' ELSE 'conflict' END AS verdict FROM t""",
)
def transactions_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction an order over its customer: some read an older version, some would create what is there; of the rest one a customer is accepted."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    operations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("c_custkey"))
    fields = ["c_name", "c_mktsegment"]
    read = transactions.planned(operations, customer, "c_custkey", fields)
    outdated = F.when(F.col("txn") % 6 == 0, "an older version").when(F.col("txn") % 35 == 0, F.lit(None)).otherwise(F.coalesce("read", F.lit("gone since")))
    return transactions.decided(read.withColumn("read", outdated), transactions.versions(customer, "c_custkey", fields), "c_custkey")
