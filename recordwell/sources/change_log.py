"""The change log: monthly shards of JSON lines, read by splits with their line numbers, and a cursor of lines per shard.

A task that starts in the middle of a shard can't know its line numbers. So lines are first counted by split; sums over a shard's splits, a row
each, give the number before each split, and the log is read with these. A split that the count didn't see (a shard
changed in between) is an error, never a wrong number. A cursor holds the lines of each shard that are done. As the log only grows at the
ends of its shards, a reader that takes events in the order of (shard, line) has done a beginning of each, and starts there again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import kept, ship

EVENT = "event_id string, at timestamp, actor string, op string, object string, record_id string, txn string, changes map<string,array<string>>, origin struct<kind:string,ref:string,run_id:string,workflow:string>, caused_by string, schema_change boolean"
CURSOR = "shard string, line long"
#: Splits whose places are sent to all tasks (about 100 bytes each); more are joined by a shuffle.
MOST_SPLITS = 200_000


def with_pairs(rows: DataFrame) -> DataFrame:
    """changes as a map of field to (old, new)."""
    pair = lambda _, v: F.struct(F.get(v, F.lit(0)).alias("old"), F.get(v, F.lit(1)).alias("new"))
    return rows.withColumn("changes", F.transform_values("changes", pair))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start, nth, line): lines by their place in the split that begins at `start`."""
    ship(spark)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").option("lineSep", "\n").text(path)
    rows = raw.select(F.concat_ws("/", F.nullif(F.regexp_extract("_metadata.file_path", r"/(month=[^/]+)/", 1), F.lit("")), name).alias("shard"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, start = batch.column("shard"), batch.column("start").to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows, bool)
            new[1:] = (start[1:] != start[:-1]) | pc.not_equal(shard.slice(1), shard.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = key != (shard[0].as_py(), int(start[0]))
            first = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))
            place = np.arange(batch.num_rows) - np.maximum(first, 0) + np.where(first < 0, done, 0)
            key, done = (shard[-1].as_py(), int(start[-1])), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([shard, batch.column("start"), pa.array(place + 1, pa.int64()), batch.column("line")], ["shard", "start", "nth", "line"])

    return rows.mapInArrow(run, "shard string, start long, nth long, line string")


def _splits(lines: DataFrame) -> DataFrame:
    """(shard, start, before, lines): the lines of the shard before each split, and in it. A table; a row a split."""
    counted = kept(lines.groupBy("shard", "start").agg(F.max("nth").alias("lines")), "log-splits")
    before = F.sum("lines").over(Window.partitionBy("shard").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("shard", "start", F.coalesce(before, F.lit(0)).alias("before"), "lines")


def _events(lines: DataFrame, splits: DataFrame, cursor: DataFrame | None) -> DataFrame:
    places = splits.select("shard", "start", "before")
    if cursor is not None:
        done = cursor.groupBy("shard").agg(F.max("line").alias("done"))
        places = places.join(done, "shard", "left")
    else:
        places = places.withColumn("done", F.lit(0).cast("long"))
    small = splits.count() <= MOST_SPLITS
    numbered = lines.join(F.broadcast(places) if small else places, ["shard", "start"], "left").withColumn("seq", F.col("before") + F.col("nth"))
    known = F.when(F.col("before").isNull(), F.raise_error(F.concat(F.lit("the log changed while it was read: "), F.col("shard"))).cast("boolean")).otherwise(F.col("seq") > F.coalesce("done", F.lit(0)))
    rows = numbered.where(known).where(F.col("line").rlike(r"\S"))
    parsed = rows.withColumn("e", F.from_json("line", f"{EVENT}, misfit string", {"columnNameOfCorruptRecord": "misfit"}))
    misfit = F.col("e").isNull() | F.col("e.misfit").isNotNull()
    fatal = F.raise_error(F.concat(F.col("shard"), F.lit(":"), F.col("seq").cast("string"), F.lit(": invalid JSON"))).cast("boolean")
    checked = parsed.where(F.when(misfit & F.try_parse_json("line").isNull(), fatal).otherwise(F.lit(True)))
    return with_pairs(checked.select("e.*", "shard", "seq", F.when(misfit, "invalid-event").alias("problem")).drop("misfit"))


def read_events(spark: SparkSession, path: str, cursor: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """The events of a log below a folder: the columns of EVENT, `shard`, `seq` (the line's number in it) and `problem`.

    With a cursor (shard, line) only those behind it. Blank lines count and are no events. A line that isn't JSON fails the job with its place; one
    whose values don't fit an event's types is a row with the problem `invalid-event` and nulls. An empty folder gives no rows. Shards
    that append_events writes are named by month and file.

    A stream reads each file once, so a shard must be complete when it appears; it knows no line numbers, and its seq is a hash of
    the event's id, which gives events of one instant an order that never changes.
    """
    if stream:
        rows = spark.readStream.schema(EVENT).option("pathGlobFilter", "*.jsonl").json(path)
        return with_pairs(rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).withColumn("seq", F.xxhash64("event_id")))
    lines = _lines(spark, path)
    return _events(lines, _splits(lines), cursor)


def log_end(spark: SparkSession, path: str) -> DataFrame:
    """The cursor (shard, line) behind all lines of the log, blank ones included."""
    return _splits(_lines(spark, path)).groupBy("shard").agg(F.max(F.col("before") + F.col("lines")).alias("line"))


def due(events: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(the first `most` of these events in the order of (shard, seq), the first event left behind: no row if none is).

    What isn't among them stays behind the cursor that `moved` gives, so nothing is dropped. Both are top-k plans.
    """
    ordered = events.orderBy("shard", "seq")
    return ordered.limit(most), ordered.select("shard", "seq").offset(most).limit(1)


def moved(cursor: DataFrame, end: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """The cursor after a reading: at the log's end, or before the first event that was left behind (a table of at most one row)."""
    old = cursor.groupBy("shard").agg(F.max("line").alias("done"))
    both = end.join(old, "shard", "full").select("shard", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("done", F.lit(0)).alias("done"))
    at = stop.first() if stop is not None else None
    reached = F.greatest("line", "done")
    if at is not None:
        reached = F.when(F.col("shard") < at.shard, reached).when(F.col("shard") == at.shard, F.greatest("done", F.lit(at.seq - 1))).otherwise(F.col("done"))
    return both.select("shard", reached.cast("long").alias("line")).where("line > 0")
