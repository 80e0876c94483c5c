"""Plans that carry what they have read: a transaction is applied as a whole, or refused as a whole.

Each operation names the version of the record that its plan saw. A transaction is stale if a present version differs, or if a record that it
would create is there already; one join with the present versions finds that for all transactions. Of those left, earlier ones go
first: a transaction is accepted once none before it touches any of its records, and refused once an accepted one does, over rounds of
aggregates. A refused one holds nobody up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import kept
from .changes import plan_hash


def versions(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, version): a hash of each record's fields."""
    return plan_hash(records.select(key, *fields)).select(key, F.col("plan_sha256").alias("version"))


def planned(operations: DataFrame, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """operations with `read`, the version of the record that each would change; null where there is none."""
    return operations.join(versions(records, key, fields).withColumnRenamed("version", "read"), key, "left")


def stale(operations: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(txn, n_stale): transactions with operations that read another version than the present one."""
    now = present.select(F.col(key).alias("s_key"), F.col("version").alias("s_version"))
    joined = operations.join(now, F.col(key) == F.col("s_key"), "left").where(~F.col("read").eqNullSafe(F.col("s_version")))
    return joined.groupBy("txn").agg(F.count(F.lit(1)).alias("n_stale"))


def decided(operations: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(txn, verdict): accepted, stale or conflict, for each transaction of operations (txn, place, key, read); place orders transactions.

    Repeated operations count once. A null key makes its transaction stale.
    """
    each = kept(operations.select("txn", "place", key, "read").distinct(), "operations")
    old = kept(stale(each, present, key).unionByName(each.where(F.col(key).isNull()).select("txn", F.lit(1).cast("long").alias("n_stale"))).select("txn").distinct(), "stale")
    open_ = kept(each.join(old, "txn", "left_anti").select("txn", "place", key).distinct(), "open")
    out = [old.select("txn", F.lit("stale").alias("verdict"))]
    turn = 0
    while not open_.isEmpty():
        first = open_.groupBy(key).agg(F.min(F.struct("place", "txn")).alias("first"))
        ranked = open_.join(first, key).groupBy("txn").agg(F.bool_and(F.col("first.txn") == F.col("txn")).alias("free"))
        won = kept(ranked.where("free").select("txn"), f"won-{turn}")
        taken = open_.join(won, "txn", "left_semi").select(key).distinct()
        lost = kept(open_.join(won, "txn", "left_anti").join(taken, key, "left_semi").select("txn").distinct(), f"lost-{turn}")
        out += [won.select("txn", F.lit("accepted").alias("verdict")), lost.select("txn", F.lit("conflict").alias("verdict"))]
        open_ = kept(open_.join(won, "txn", "left_anti").join(lost, "txn", "left_anti"), f"open-{turn}")
        turn += 1
    every = out[0]
    for frame in out[1:]:
        every = every.unionByName(frame)
    return every


def accepted(operations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The operations of accepted transactions."""
    return operations.join(verdicts.where("verdict = 'accepted'").select("txn"), "txn", "left_semi")
