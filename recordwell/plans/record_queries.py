"""Filters, pages, aggregates and views over the sample records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import Context
from ..functions.dates import GRAINS, gap_filled
from ..functions.values import display, instant_text, option_position, value
from ..operators import views
from ..operators.aggregates import aggregate_column, by_currency, expected, grouped, unique_values
from ..operators.filters import condition, matching
from ..operators.sorting import page
from . import crm
from .crm import COMPANY, NOW, OPPORTUNITY, PRODUCT
from .registry import query, table

#: Orders as opportunities, for the SQL twins.
OPP = """opp AS (SELECT o_orderkey, o_custkey, o_orderstatus AS stage, nullif(o_orderpriority, '5-LOW') AS priority, o_orderdate AS close,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders)"""
LOCAL_DAY = "CAST(timezone('Europe/Berlin', timezone('UTC', close)) AS DATE)"
CODE = "CASE n.c_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'CHF' WHEN 2 THEN '' ELSE 'EUR' END"


def _where(spark: SparkSession, sf_dir: str, spec, context: Context = NOW) -> DataFrame:
    return matching(crm.opportunities(spark, sf_dir), OPPORTUNITY, spec, context)


@query(
    "filter_groups_two_valued",
    f"WITH {OPP} SELECT o_orderkey FROM opp WHERE (coalesce(lower(priority) <> '1-urgent', true) AND (coalesce(amount >= 250000, false) OR priority IS NULL)) AND NOT (coalesce(lower(stage) = 'f', false) AND coalesce(amount <= 300000, false))",
)
def filter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {
        "op": "AND",
        "conditions": [
            {"field": "priority", "operand": "IS_NOT", "value": "1-urgent"},
            {"op": "OR", "conditions": [{"field": "amount", "operand": "GREATER_THAN_OR_EQUAL", "value": "250000"}, {"field": "priority", "operand": "IS_EMPTY"}]},
            {"op": "NOT", "conditions": [{"field": "stage", "operand": "IS", "value": "F"}, {"field": "amount", "operand": "lessThan", "value": 300000}]},
        ],
    }
    return _where(spark, sf_dir, spec).select("o_orderkey")


@query("filter_contains_casefold", "SELECT c_custkey FROM customer WHERE coalesce(contains(lower(CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END), 'uil'), false) OR NOT contains(lower(c_name), '1')")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"op": "OR", "conditions": [{"field": "segment", "operand": "CONTAINS", "value": "UIL"}, {"field": "name", "operand": "DOES_NOT_CONTAIN", "value": "1"}]}
    return crm.companies(spark, sf_dir).where(condition(COMPANY, spec, NOW)).select("c_custkey")


@query("filter_list_membership", "SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0 AND (list_contains(string_split(lower(p_name), ' '), 'red') OR list_contains(string_split(lower(p_name), ' '), 'small'))")
def filter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.products(spark, sf_dir).where(condition(PRODUCT, [{"field": "colors", "operand": "CONTAINS", "value": ["RED", "Small"]}], NOW)).select("p_partkey")


@query("filter_is_empty", "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'empty' ELSE 'set' END AS state, count(*) AS n FROM customer GROUP BY 1")
def filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = crm.companies(spark, sf_dir)
    state = F.when(condition(COMPANY, {"field": "segment", "operand": "IS_EMPTY"}, NOW), "empty").when(condition(COMPANY, {"field": "segment", "operand": "isNotEmpty"}, NOW), "set")
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_relative_range",
    f"""WITH {OPP}, d AS (SELECT o_orderkey, {LOCAL_DAY} AS day, close FROM opp)
SELECT o_orderkey, CASE WHEN day BETWEEN DATE '1998-05-15' AND DATE '1998-06-14' THEN 'past month' WHEN day BETWEEN DATE '1998-04-01' AND DATE '1998-06-30' THEN 'this quarter'
 WHEN day BETWEEN DATE '1998-06-16' AND DATE '1998-06-29' THEN 'next weeks' ELSE 'future' END AS period
FROM d WHERE day BETWEEN DATE '1998-04-01' AND DATE '1998-06-30' OR (close > TIMESTAMP '1998-06-15 08:00:00' AND day < DATE '1998-08-01')""",
)
def filter_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda operand, x=None: condition(OPPORTUNITY, {"field": "closeDate", "operand": operand, "value": x}, NOW)
    rows = _where(spark, sf_dir, {"op": "OR", "conditions": [{"field": "closeDate", "operand": "IS_RELATIVE", "value": "THIS_1_QUARTER"}, [{"field": "closeDate", "operand": "IS_IN_FUTURE"}, {"field": "closeDate", "operand": "IS_BEFORE", "value": "1998-08-01"}]]})
    period = F.when(leaf("IS_RELATIVE", "PAST_1_MONTH"), "past month").when(leaf("IS_RELATIVE", "THIS_1_QUARTER"), "this quarter").when(leaf("IS_RELATIVE", "NEXT_2_WEEK"), "next weeks").otherwise("future")
    return rows.select("o_orderkey", period.alias("period"))


@query("filter_rating_numeric", "SELECT p_partkey FROM part WHERE p_partkey % 6 >= 4 OR (p_partkey % 6 > 0 AND p_partkey % 6 <= 1)")
def filter_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"op": "OR", "conditions": [{"field": "rating", "operand": "GREATER_THAN_OR_EQUAL", "value": "RATING_4"}, {"field": "rating", "operand": "LESS_THAN_OR_EQUAL", "value": 1}]}
    return crm.products(spark, sf_dir).where(condition(PRODUCT, spec, NOW)).select("p_partkey")


@query(
    "find_sorted_page",
    f"""WITH {OPP} SELECT o_orderkey, c_name AS company, amount FROM opp LEFT JOIN customer ON o_custkey = c_custkey WHERE stage <> 'P'
ORDER BY lower(c_name) NULLS LAST, amount DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) LIMIT 100 OFFSET 40""",
)
def find_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crm.opportunities(spark, sf_dir, with_company=True).where(condition(OPPORTUNITY, {"field": "stage", "operand": "IS_NOT", "value": "p"}, NOW))
    found = page(rows, OPPORTUNITY, [{"field": "company"}, {"field": "amount", "direction": "desc"}], limit=100, offset=40)
    return found.select("o_orderkey", F.col("company.title").alias("company"), value(OPPORTUNITY, "amount").column.cast("decimal(18,2)").alias("amount"))


@query(
    "sort_by_option_order",
    f"WITH {OPP} SELECT o_orderkey, priority, list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-NEVER'], priority) AS option_no FROM opp ORDER BY option_no DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)",
)
def by_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page(crm.opportunities(spark, sf_dir), OPPORTUNITY, [{"field": "priority", "direction": "desc"}], limit=None)
    return found.select("o_orderkey", "priority", option_position(value(OPPORTUNITY, "priority")).cast("int").alias("option_no"))


_ALL = """count(*) AS n, count(DISTINCT lower(priority)) AS n_unique, count(*) FILTER (amount IS NULL) AS n_empty, count(amount) AS n_set,
 CAST(round(100.0 * count(*) FILTER (amount IS NULL) / count(*), 6) AS DECIMAL(38,6)) AS pct_empty, CAST(round(100.0 * count(amount) / count(*), 6) AS DECIMAL(38,6)) AS pct_set,
 CAST(sum(amount) AS DECIMAL(38,6)) AS total, CAST(min(amount) AS DECIMAL(38,6)) AS least, CAST(max(amount) AS DECIMAL(38,6)) AS most, CAST(min(close) AS DATE) AS first_day"""


@query("agg_all_functions", f"WITH {OPP} SELECT stage, {_ALL} FROM opp GROUP BY stage")
def all_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, priority, close = (value(OPPORTUNITY, k) for k in ("amount", "priority", "closeDate"))
    made = {"n": ("COUNT", None), "n_unique": ("COUNT_UNIQUE_VALUES", priority), "n_empty": ("COUNT_EMPTY", amount), "n_set": ("COUNT_NOT_EMPTY", amount), "pct_empty": ("PERCENTAGE_EMPTY", amount), "pct_set": ("PERCENTAGE_NOT_EMPTY", amount), "total": ("SUM", amount), "least": ("MIN", amount), "most": ("MAX", amount)}
    aggs = [aggregate_column(f, v).alias(k) for k, (f, v) in made.items()]
    return crm.opportunities(spark, sf_dir).groupBy("stage").agg(*aggs, aggregate_column("MIN", close).cast("date").alias("first_day"))


@query("agg_average", "WITH s AS (SELECT o_orderstatus AS stage, CAST(sum(CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END) AS HUGEINT) * 10000 AS micros, count(*) FILTER (o_orderkey % 11 <> 0) AS n FROM orders GROUP BY 1) SELECT stage, CAST(CAST((2 * micros + n) // (2 * n) AS DECIMAL(38,0)) / 1000000 AS DECIMAL(20,4)) AS average, n AS n_set FROM s")
def mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = value(OPPORTUNITY, "amount")
    return crm.opportunities(spark, sf_dir).groupBy("stage").agg(aggregate_column("AVERAGE", amount).cast("decimal(20,4)").alias("average"), aggregate_column("COUNT_NOT_EMPTY", amount).alias("n_set"))


@query("agg_average_exact", "SELECT l_returnflag, CAST(CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * 1000000) AS HUGEINT) // count(*) AS DECIMAL(38,0)) AS avg_micros, count(*) AS n FROM lineitem GROUP BY 1")
def average(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.floor(F.sum(q * 1_000_000) / F.count(F.lit(1))).cast("decimal(38,0)").alias("avg_micros"), F.count(F.lit(1)).alias("n"))


_BUCKET = {
    "DAY": "strftime(day, '%Y-%m-%d')", "WEEK": "strftime(day, '%G-W%V')", "MONTH": "strftime(day, '%Y-%m')", "QUARTER": "CAST(year(day) AS VARCHAR) || '-Q' || CAST(quarter(day) AS VARCHAR)", "YEAR": "CAST(year(day) AS VARCHAR)",
    "DAY_OF_WEEK": "CAST(isodow(day) AS VARCHAR)", "MONTH_OF_YEAR": "strftime(day, '%m')", "QUARTER_OF_YEAR": "'Q' || CAST(quarter(day) AS VARCHAR)",
}
for _grain in GRAINS:

    @query(
        f"agg_by_date_bucket_{_grain.lower()}",
        f"WITH {OPP}, d AS (SELECT {LOCAL_DAY} AS day, amount FROM opp) SELECT {_BUCKET[_grain]} AS group_key, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS value FROM d GROUP BY 1",
    )
    def by_bucket(spark: SparkSession, sf_dir: str, grain: str = _grain) -> DataFrame:
        return grouped(crm.opportunities(spark, sf_dir), OPPORTUNITY, "SUM", "amount", "closeDate", grain, NOW)


@query(
    "agg_group_options_filled",
    f"""WITH {OPP}, opts AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW','6-NEVER']) AS k, unnest([0,1,2,3,4,5]) AS position),
g AS (SELECT coalesce(priority, '') AS k, sum(amount) AS v FROM opp GROUP BY 1)
SELECT coalesce(o.k, g.k) AS group_key, CAST(coalesce(g.v, 0) AS DECIMAL(38,6)) AS value, position FROM opts o FULL JOIN g ON o.k = g.k""",
)
def options_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(crm.opportunities(spark, sf_dir), OPPORTUNITY, "SUM", "amount", "priority")


@query(
    "agg_currency_split",
    f"""WITH {OPP}, x AS (SELECT opp.*, {CODE} AS currency FROM opp JOIN customer n ON o_custkey = c_custkey)
SELECT stage, currency, CAST(sum(amount) AS DECIMAL(38,6)) AS value, count(*) AS n, CASE currency WHEN 'EUR' THEN 0 WHEN '' THEN 2 ELSE 1 END AS code_rank FROM x WHERE amount IS NOT NULL GROUP BY 1, 2""",
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_currency(crm.opportunities(spark, sf_dir, with_company=True), OPPORTUNITY, "SUM", "amount", "EUR", [F.col("stage")])


@query(
    "expected_amount_by_stage",
    f"""WITH {OPP}, x AS (SELECT opp.*, {CODE} AS currency, CASE stage WHEN 'F' THEN CAST(1 AS DECIMAL(9,6)) WHEN 'O' THEN CAST(0.25 AS DECIMAL(9,6)) END AS share FROM opp JOIN customer n ON o_custkey = c_custkey)
SELECT stage, currency, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,6)) AS amount, CAST(sum(CAST(amount * share AS DECIMAL(38,6))) AS DECIMAL(38,6)) AS expected, count(*) FILTER (share IS NULL) AS n_without_share
FROM x WHERE amount IS NOT NULL GROUP BY 1, 2""",
)
def expected_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected(crm.opportunities(spark, sf_dir, with_company=True), OPPORTUNITY, "amount", "stage", {"F": "1", "O": "0.25"})


@query(
    "multi_group_explode",
    "WITH p AS (SELECT p_size, CASE WHEN p_partkey % 9 = 0 THEN [''] ELSE string_split(p_name, ' ') END AS ks FROM part), e AS (SELECT unnest(ks) AS group_key, p_size FROM p) SELECT group_key, CAST(sum(p_size) AS DECIMAL(38,6)) AS value FROM e GROUP BY 1",
)
def multi_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(crm.products(spark, sf_dir), PRODUCT, "SUM", "size", "colors").drop("position")


@query("unique_values_of_lists", "WITH e AS (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS one FROM part WHERE p_partkey % 9 <> 0) SELECT b.p_brand, coalesce(n, 0) AS unique_values FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand, count(DISTINCT one) AS n FROM e GROUP BY 1) x ON b.p_brand = x.p_brand")
def unique_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("brand_of"), "p_brand")
    return unique_values(crm.products(spark, sf_dir).join(brands, F.col("p_partkey") == F.col("brand_of")), PRODUCT, "colors", ["p_brand"])


@query(
    "display_values",
    f"""WITH {OPP} SELECT o_orderkey, CASE WHEN amount IS NULL THEN 'EUR' ELSE replace(replace(replace(format('{{:,}}', CAST(trunc(amount) AS BIGINT)), ',', '.') || ',' || lpad(CAST(CAST((amount - trunc(amount)) * 100 AS BIGINT) AS VARCHAR), 2, '0'), '~', ''), '~', '') || ' EUR' END AS shown,
 strftime(timezone('Europe/Berlin', timezone('UTC', close)), '%d.%m.%Y %H:%M') AS closes FROM opp""",
)
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.opportunities(spark, sf_dir).select("o_orderkey", display(OPPORTUNITY, "amount", "DOTS_AND_COMMA").alias("shown"), instant_text(F.col("closeDate"), NOW).alias("closes"))


@query(
    "kanban_board",
    f"""WITH {OPP}, opts AS (SELECT unnest(['F','O','P','X','']) AS k, unnest([0,1,2,3,4]) AS position), g AS (SELECT stage, count(*) AS cards, CAST(sum(amount) AS DECIMAL(38,6)) AS total FROM opp GROUP BY 1)
SELECT position, k AS "column", coalesce(cards, 0) AS cards, total FROM opts LEFT JOIN g ON k = stage""",
)
def kanban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.board(crm.opportunities(spark, sf_dir), OPPORTUNITY, "stage", {"total": aggregate_column("SUM", value(OPPORTUNITY, "amount"))})


@query(
    "table_footer_totals",
    f"""WITH {OPP} SELECT stage AS footer_group, CAST(grouping(stage) AS TINYINT) AS is_total, CAST(sum(amount) AS DECIMAL(38,6)) AS amount_sum, count(*) FILTER (priority IS NULL) AS priority_count_empty FROM opp GROUP BY ROLLUP(stage)""",
)
def footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table_footer(crm.opportunities(spark, sf_dir), OPPORTUNITY, {"amount": "SUM", "priority": "COUNT_EMPTY"}, F.col("stage"))


@query("calendar_local_day", "SELECT CAST(timezone('Europe/Berlin', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n, min(strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%H:%M')) AS first_at FROM events GROUP BY 1")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.calendar(table(spark, sf_dir, "events"), F.col("ts").cast("timestamp"), NOW, [F.col("event_id")])
    return placed.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


@query(
    "two_level_group",
    """WITH x AS (SELECT p_type AS g1, p_brand AS b FROM part), s AS (SELECT b, count(*) AS n FROM x GROUP BY 1), k AS (SELECT b FROM s ORDER BY n DESC, b LIMIT 7)
SELECT g1, CASE WHEN b IN (SELECT b FROM k) THEN b ELSE 'other' END AS g2, count(*) AS value FROM x GROUP BY 1, 2""",
)
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.two_level(table(spark, sf_dir, "part"), F.col("p_type"), F.col("p_brand"), F.count(F.lit(1)), merge=F.sum("value"))


@query(
    "top_n_other",
    """WITH g AS (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, CAST(l_suppkey AS VARCHAR)) AS rk FROM g)
SELECT CASE WHEN rk <= 10 THEN CAST(l_suppkey AS VARCHAR) ELSE 'other' END AS supplier, CAST(sum(total) AS DECIMAL(38,2)) AS total, CAST(count(*) FILTER (rk > 10) AS BIGINT) AS n_folded FROM r GROUP BY 1""",
)
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("supplier")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    return views.top_with_other(groups, "supplier", "total", 10).withColumn("total", F.col("total").cast("decimal(38,2)"))


@query(
    "cumulative_month",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS stage, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1, 2)
SELECT month, stage, CAST(total AS DECIMAL(38,2)) AS total, CAST(sum(total) OVER (PARTITION BY stage ORDER BY month ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS running_total FROM m""",
)
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("stage")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    out = views.cumulative(months, "month", "total", ["stage"])
    return out.select("month", "stage", F.col("total").cast("decimal(38,2)").alias("total"), F.col("running_total").cast("decimal(38,2)").alias("running_total"))


@query(
    "gap_filled_month",
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders WHERE month(o_orderdate) NOT IN (3, 7) GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(bucket) AS TIMESTAMP) FROM m), (SELECT CAST(max(bucket) AS TIMESTAMP) FROM m), INTERVAL 1 MONTH)) AS DATE) AS bucket) SELECT s.bucket, coalesce(n, 0) AS n FROM s LEFT JOIN m ON s.bucket = m.bucket""",
)
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(~F.month("o_orderdate").isin(3, 7))
    months = o.groupBy(F.trunc("o_orderdate", "month").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return gap_filled(months, "bucket", "MONTH", {"n": 0})
