"""Change log: stages over time, latest entries, timelines, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..deploy import ensure_checkpoint
from ..functions.dates import days_of


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an aggregate of the whole row, so a busy key is combined before the shuffle."""
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")


def tail(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The last `limit` rows, in ascending order."""
    back = [c.desc() for c in order]
    return df.orderBy(*back).limit(limit).orderBy(*order)


def changes_of(events: DataFrame, field: str) -> DataFrame:
    """(record_id, at, seq, before, after, kind) of the log's changes to one field."""
    c = F.try_element_at("changes", F.lit(field))
    kind = F.when((F.col("origin.kind") == "migration") | F.coalesce(F.col("schema_change"), F.lit(False)), "migration").when(F.col("origin.kind") == "import", "import").otherwise("event")
    return events.where(c.isNotNull() & F.col("at").isNotNull()).select("record_id", "at", "seq", c.old.alias("before"), c.new.alias("after"), kind.alias("kind"))


def stage_intervals(changes: DataFrame, records: DataFrame) -> DataFrame:
    """Intervals (record_id, k, stage, start, end, basis) from changes (record_id, at, seq, before, after, kind) and
    records (record_id, created_at, deleted_at, value).

    Migrations rename what came before and move nothing. Windows find the intervals; those of records with migrations are
    then renamed, a round for each link of a chain of renamings. A record that never moved, though its stage may have been
    renamed, is in its present stage since its creation.
    """
    migrated = changes.where("kind = 'migration'").select("record_id").distinct()
    if migrated.isEmpty():
        intervals = _by_window(changes, records)
    else:
        plain = changes.join(migrated, "record_id", "left_anti")
        intervals = _by_window(plain, records).unionByName(_by_fold(changes.join(migrated, "record_id", "left_semi"), records))
    touched = changes.where("kind <> 'migration' and (before <> '' or after <> '')").select("record_id").distinct()
    still = records.join(touched, "record_id", "left_anti").where("value is not null and value <> ''")
    still = still.select("record_id", F.lit(1).alias("k"), F.col("value").alias("stage"), F.col("created_at").alias("start"), F.col("deleted_at").alias("end"), F.when(F.col("created_at").isNotNull(), "crm_created_at").otherwise("unknown").alias("basis"))
    return intervals.unionByName(still)


def _by_window(changes: DataFrame, records: DataFrame) -> DataFrame:
    w = Window.partitionBy("record_id").orderBy("at", "seq")
    no = lambda c: F.col(c).isNull() | (F.col(c) == "")
    moves = changes.withColumns({"next_at": F.lead("at").over(w), "n": F.row_number().over(w), "first": _none_yet(w)}).join(records, "record_id")
    opens = F.when(F.col("first") & ~no("before"), F.struct(F.lit(0).alias("o"), F.col("before").alias("stage"), F.when(F.col("created_at") <= F.col("at"), F.col("created_at")).alias("start"), F.col("at").alias("end"), F.when(F.col("created_at") <= F.col("at"), "crm_created_at").otherwise("unknown").alias("basis")))
    runs = F.when(~no("after"), F.struct(F.lit(1).alias("o"), F.col("after").alias("stage"), F.col("at").alias("start"), F.coalesce("next_at", "deleted_at").alias("end"), F.col("kind").alias("basis")))
    each = moves.select("record_id", (F.col("n") * 2).alias("n"), F.explode(F.filter(F.array(opens, runs), lambda x: x.isNotNull())).alias("x"))
    return each.select("record_id", (F.col("n") + F.col("x.o")).cast("int").alias("k"), "x.stage", "x.start", "x.end", "x.basis")


def _none_yet(w: WindowSpec) -> Column:
    """Whether no move before this one, in the window's order, had a stage on either side."""
    return F.coalesce(F.count(F.when((F.col("before") != "") | (F.col("after") != ""), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 0, F.lit(True))


def _by_fold(changes: DataFrame, records: DataFrame) -> DataFrame:
    """The same for records whose stages were renamed, by windows over each record's log.

    A migration from a to b renames what stands before it. So a stage that a move set carries, in the end, the name to which the
    migrations behind it lead: each renaming is told to the moves before it, in order, by joins over the few migrations.
    """
    w = Window.partitionBy("record_id").orderBy("at", "seq")
    placed = changes.withColumn("n", F.row_number().over(w))
    moves, renames = placed.where("kind <> 'migration'"), placed.where("kind = 'migration'")
    own = Window.partitionBy("record_id").orderBy("n")
    moved = moves.withColumns({"next_at": F.lead("at").over(own), "k0": F.row_number().over(own), "first": _none_yet(own)}).join(records, "record_id")
    no = lambda c: F.col(c).isNull() | (F.col(c) == "")
    known = F.col("created_at") <= F.col("at")
    opens = F.when(F.col("first") & ~no("before"), F.struct(F.lit(0).alias("o"), F.col("before").alias("stage"), F.when(known, F.col("created_at")).alias("start"), F.col("at").alias("end"), F.when(known, "crm_created_at").otherwise("unknown").alias("basis")))
    runs = F.when(~no("after"), F.struct(F.lit(1).alias("o"), F.col("after").alias("stage"), F.col("at").alias("start"), F.coalesce("next_at", "deleted_at").alias("end"), F.col("kind").alias("basis")))
    each = moved.select("record_id", "n", (F.col("k0") * 2).alias("k0"), F.explode(F.filter(F.array(opens, runs), lambda x: x.isNotNull())).alias("x"))
    rows = each.select("record_id", "n", (F.col("k0") + F.col("x.o")).cast("int").alias("k"), "x.stage", "x.start", "x.end", "x.basis")
    return _renamed(rows, renames)


def _renamed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Intervals under the names to which later migrations lead; one that leads to nothing leaves no name and ends the interval."""
    ensure_checkpoint(rows.sparkSession)
    each = renames.select(F.col("record_id").alias("r_id"), F.col("n").alias("r_n"), F.col("before").alias("r_from"), F.col("after").alias("r_to"), F.col("at").alias("r_at"))
    done = None
    now = rows.withColumn("seen", F.col("n"))
    while True:
        first = now.join(each, (F.col("record_id") == F.col("r_id")) & (F.col("r_n") > F.col("seen")) & (F.col("r_from") == F.col("stage")))
        hit = first.groupBy("record_id", "k").agg(F.min_by(F.struct("r_n", "r_to", "r_at"), "r_n").alias("r"))
        told = now.join(hit, ["record_id", "k"], "left").checkpoint()
        still = told.where("r is null").drop("r", "seen", "n")
        done = still if done is None else done.unionByName(still)
        led = told.where("r is not null")
        if led.isEmpty():
            return done
        gone = F.col("r.r_to").isNull() | (F.col("r.r_to") == "")
        now = led.select("record_id", "n", "k", F.col("r.r_to").alias("stage"), "start", F.when(gone & (F.col("end").isNull() | (F.col("end") > F.col("r.r_at"))), F.col("r.r_at")).otherwise(F.col("end")).alias("end"), "basis", F.col("r.r_n").alias("seen"))


def renamed_stages(intervals: DataFrame, previous: dict[str, str]) -> DataFrame:
    """History under an option's earlier value belongs to the option that now carries it."""
    return intervals.replace(previous, subset=["stage"]) if previous else intervals


def time_in_stage(intervals: DataFrame, now: Column) -> DataFrame:
    """(stage, completed_intervals, average_days_completed, records_in_stage, average_days_now, intervals_without_start)."""
    seconds = F.greatest(F.lit(0), F.unix_seconds(F.coalesce("end", now)) - F.unix_seconds("start"))
    rows = intervals.select("stage", F.col("end").isNull().alias("open"), seconds.alias("s"))
    mean = lambda c: days_of(F.floor(F.sum(F.when(c, F.col("s"))).cast("decimal(30,0)") / F.nullif(F.count_if(c), F.lit(0))))
    done, still = F.col("s").isNotNull() & ~F.col("open"), F.col("s").isNotNull() & F.col("open")
    return rows.groupBy("stage").agg(
        F.count_if(done).alias("completed_intervals"), mean(done).alias("average_days_completed"), F.count_if(still).alias("records_in_stage"), mean(still).alias("average_days_now"), F.count_if(F.col("s").isNull()).alias("intervals_without_start"),
    )


def stage_since(changes: DataFrame) -> DataFrame:
    """(record_id, since) of each record's last move."""
    return changes.where("kind <> 'migration'").groupBy("record_id").agg(F.max("at").alias("since"))


def record_order(events: DataFrame, order: list[Column], moved: Column | None = None) -> DataFrame:
    """events with `n`, their place within their record, and with `moved` the number of its moves so far, both by `order`."""
    own = Window.partitionBy("record_id").orderBy(*order)
    out = events.withColumn("n", F.row_number().over(own))
    return out if moved is None else out.withColumn("moves", F.count(F.when(moved, 1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))


def run_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The run log, JSON lines: (run_id, logged_at, seq, workflow, version, status, depth, steps map, outbox array)."""
    kind = "run_id string, logged_at timestamp, workflow string, version string, status string, depth int, steps map<string,string>, outbox array<string>"
    rows = (spark.readStream if stream else spark.read).schema(kind).option("pathGlobFilter", "*.jsonl").json(path)
    return rows.withColumn("seq", F.xxhash64("run_id", "logged_at") if stream else F.monotonically_increasing_id())


def run_summaries(log: DataFrame) -> DataFrame:
    """A row a run from its log entries (run_id, logged_at, seq, status, steps map, outbox array): latest state, all steps, distinct outbox."""
    state = latest(log.select("run_id", "logged_at", "seq", "status"), ["run_id"], [F.col("logged_at"), F.col("seq")])
    steps = log.select("run_id", "logged_at", "seq", F.explode("steps").alias("step", "result"))
    last = steps.groupBy("run_id", "step").agg(F.max_by("result", F.struct("logged_at", "seq")).alias("result"))
    n_steps = last.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("result") == "FAILED").alias("n_failed"))
    box = log.select("run_id", F.explode("outbox").alias("o")).distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("n_outbox"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return state.join(n_steps, "run_id", "left").join(box, "run_id", "left").select("run_id", "logged_at", "status", zero("n_steps"), zero("n_failed"), zero("n_outbox"))
