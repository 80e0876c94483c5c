"""The sample tables as typed records: customers are companies, orders opportunities, events a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import Context
from ..schema import Model
from .registry import table

NOW = Context.at("1998-06-15T08:00:00+00:00", "Europe/Berlin", me="Clerk")
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]
STAGES = ["F", "O", "P", "X"]

MODEL = Model.from_document(
    {
        "objects": {
            "company": {"labelField": "name", "fields": {"name": {"type": "TEXT"}, "segment": {"type": "TEXT"}, "balance": {"type": "NUMBER"}, "nation": {"type": "NUMBER"}}},
            "opportunity": {
                "labelField": "name",
                "fields": {
                    "name": {"type": "TEXT"},
                    "amount": {"type": "CURRENCY"},
                    "closeDate": {"type": "DATE_TIME"},
                    "stage": {"type": "SELECT", "options": [{"value": s} for s in STAGES]},
                    "priority": {"type": "SELECT", "options": [{"value": p} for p in PRIORITIES]},
                    "company": {"type": "RELATION", "relation": {"target": "company"}},
                },
            },
            "product": {"labelField": "name", "fields": {"name": {"type": "TEXT"}, "colors": {"type": "MULTI_SELECT"}, "size": {"type": "NUMBER"}, "rating": {"type": "RATING"}}},
        }
    }
)
OPPORTUNITY, COMPANY, PRODUCT = (MODEL.object(n) for n in ("opportunity", "company", "product"))


def _system(key: str, title: str, created: str | None = None) -> list:
    return [F.col(key).cast("string").alias("crm_id"), F.col(title).cast("string").alias("crm_title"), (F.col(created).cast("timestamp") if created else F.lit(None).cast("timestamp")).alias("crm_created_at"), F.lit(None).cast("timestamp").alias("crm_deleted_at"), F.lit(None).cast("decimal(38,10)").alias("crm_position")]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(*_system("c_custkey", "c_name"), "c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").cast("decimal(18,2)").cast("decimal(38,10)").alias("balance"), F.col("c_nationkey").cast("decimal(38,10)").alias("nation"))


def currency(nation):
    """A code by territory; some have none."""
    return F.when(nation % 5 == 0, "USD").when(nation % 5 == 1, "CHF").when(nation % 5 == 2, "").otherwise("EUR")


def opportunities(spark: SparkSession, sf_dir: str, with_company: bool = False) -> DataFrame:
    """Every 11th has no amount, the lowest priority counts as none, the rest as ordered."""
    o = table(spark, sf_dir, "orders")
    code = F.lit("EUR")
    title = F.lit(None).cast("string")
    if with_company:
        c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
        o, code, title = o.join(c, "o_custkey", "left"), currency(F.col("c_nationkey")), F.col("c_name")
    micros = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_totalprice").cast("decimal(18,2)") * 1_000_000).cast("long"))
    return o.select(
        *_system("o_orderkey", "o_orderkey", "o_orderdate"), "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.struct(micros.alias("amountMicros"), code.alias("currencyCode")).alias("amount"), F.col("o_orderdate").cast("timestamp").alias("closeDate"), F.col("o_orderstatus").alias("stage"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.struct(F.lit("company").alias("object"), F.col("o_custkey").cast("string").alias("id"), title.alias("title")).alias("company"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(*_system("p_partkey", "p_name"), "p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 != 0, F.split("p_name", " ")).alias("colors"), F.col("p_size").cast("decimal(38,10)").alias("size"), F.when(F.col("p_partkey") % 6 > 0, F.concat(F.lit("RATING_"), (F.col("p_partkey") % 6).cast("string"))).alias("rating"))


def stage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves between stages: each user a record, each event a change of its stage from the one before."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("record_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"), F.lit("event").alias("kind"))
