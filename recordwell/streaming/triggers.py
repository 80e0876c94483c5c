"""Event-driven runs with Structured Streaming: matched once a workflow, waits and timers as state.

The change log is a file stream; its checkpoint is the cursor. What a batch job would count per plan, a stream
deduplicates by key within a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..deploy import shared_folder, ship
from ..functions.recurrence import cron_slots


@dataclass(frozen=True)
class Trigger:
    """Which events start a workflow: of an object, with an operation, touching watched fields."""

    workflow: str
    object: str
    operations: tuple[str, ...] = ("create", "update", "delete", "restore")
    fields: tuple[str, ...] = ()
    where: Column | None = field(default=None, compare=False)

    def holds(self) -> Column:
        """Events of a workflow's own runs don't start it again, nor those more than one run deep."""
        ok = (F.col("object") == self.object) & F.col("op").isin(list(self.operations)) & ~F.coalesce(F.col("origin.workflow") == self.workflow, F.lit(False)) & (F.coalesce(F.col("depth"), F.lit(0)) < 1)
        if self.fields:
            ok = ok & ((F.col("op") != "update") | F.arrays_overlap(F.map_keys("changes"), F.array(*map(F.lit, self.fields))))
        return F.coalesce(ok if self.where is None else ok & self.where, F.lit(False))


def runs(events: DataFrame, triggers: list[Trigger], late: str = "1 hour") -> DataFrame:
    """(workflow, event_id, record_id, at, changes_hash), each (workflow, record, changes) once; for batch and stream alike."""
    names = F.filter(F.array(*(F.when(t.holds(), F.lit(t.workflow)) for t in triggers)), lambda x: x.isNotNull())
    hashed = F.sha2(F.to_json("changes"), 256)
    each = events.select(F.explode(names).alias("workflow"), "event_id", "record_id", "at", hashed.alias("changes_hash"))
    keys = ["workflow", "record_id", "changes_hash"]
    return each.withWatermark("at", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else each.dropDuplicates(keys)


def newest_calendar_versions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Of each event the newest version seen; out-of-order updates don't win."""
    row = F.struct("sequence", "modified", "starts_at", "title")
    source = events.withWatermark("modified", late) if events.isStreaming else events
    return source.groupBy("uid").agg(F.max(row).alias("v")).select("uid", "v.*")


WAIT_STATE = "run_ids array<string>, untils array<long>"
WAIT_OUT = "record_id string, run_id string, outcome string"


def waits(requests_and_events: DataFrame) -> DataFrame:
    """Runs that wait for an event of their record: (record_id, run_id, outcome resumed or timed-out).

    Rows are (record_id, at, kind wait|event, run_id, seconds). An event ends the waits of all runs on its record,
    event time timers end those that are due. A run that waits again on a record starts its wait anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        if state.hasTimedOut:
            due = [run_id for run_id, until in waiting.items() if until <= state.getCurrentWatermarkMs()]
            out += [(key[0], run_id, "timed-out") for run_id in due]
            for run_id in due:
                del waiting[run_id]
        else:
            rows = pd.concat(list(frames)).sort_values("at")
            for r in rows.itertuples():
                now = int(r.at.timestamp() * 1000)
                if r.kind == "wait":
                    waiting[r.run_id] = now + int(r.seconds) * 1000
                else:
                    out += [(key[0], run_id, "resumed" if now <= until else "timed-out") for run_id, until in waiting.items()]
                    waiting = {}
        if waiting:
            state.update((list(waiting), list(waiting.values())))
            state.setTimeoutTimestamp(max(min(waiting.values()), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["record_id", "run_id", "outcome"])

    ship(requests_and_events.sparkSession)
    timed = requests_and_events.withWatermark("at", "10 minutes")
    return timed.groupBy("record_id").applyInPandasWithState(step, WAIT_OUT, WAIT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def with_depth(events: DataFrame, runs: DataFrame) -> DataFrame:
    """events with `depth`: one more than that of the run that wrote them (origin.run_id), 0 for those of people."""
    of_run = runs.groupBy(F.col("run_id").alias("d_run")).agg(F.max("depth").alias("d_depth"))
    joined = events.drop("depth").join(of_run, F.col("origin.run_id") == F.col("d_run"), "left")
    return joined.withColumn("depth", F.when(F.col("origin.run_id").isNotNull(), F.coalesce("d_depth", F.lit(0)) + 1).otherwise(0)).drop("d_run", "d_depth")


#: Event-driven runs that one plan starts, at most; the rest wait for the next plan, none is lost.
RUNS_PER_PLAN = 500


def planned(runs: DataFrame, most: int = RUNS_PER_PLAN) -> tuple[DataFrame, DataFrame]:
    """(runs of this plan, runs deferred to the next): the first `most` by (at, event_id, workflow). The plan is a top-k, the rest an
    anti-join with it; nothing is dropped."""
    now = runs.orderBy("at", "event_id", "workflow").limit(most)
    return now, runs.join(F.broadcast(now.select("workflow", "event_id")), ["workflow", "event_id"], "left_anti")


def catch_up(versions: DataFrame, pattern: str, now: Column) -> DataFrame:
    """One run for each version (workflow, checked_at) with slots due since it was checked: (workflow, due_slots, missed_slots, first_due_at, scheduled_at).

    However many slots were missed, one run makes up for them all, at the last.
    """
    slots = F.filter(cron_slots(pattern, F.col("checked_at"), now), lambda t: t <= now)
    due = versions.select("workflow", slots.alias("s")).where(F.size("s") > 0)
    return due.select("workflow", F.size("s").alias("due_slots"), (F.size("s") - 1).alias("missed_slots"), F.array_min("s").alias("first_due_at"), F.array_max("s").alias("scheduled_at"))


def delays(runs: DataFrame, now: Column) -> DataFrame:
    """Runs at a delay step (run_id, entered_at, days, hours, minutes, seconds, until) with `resume_at` and whether they are `due`.

    until, a moment, goes before a duration; negative durations count as none.
    """
    some = lambda c, unit: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long") * unit
    length = some("days", 86_400) + some("hours", 3600) + some("minutes", 60) + some("seconds", 1)
    resume = F.coalesce(F.col("until"), F.timestamp_seconds(F.unix_seconds("entered_at") + length))
    return runs.withColumns({"resume_at": resume, "due": resume <= now})


def delay_stream(runs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same as a stream of (run_id, entered_at, resume_at): a run comes out once event time has passed its resume_at."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "outcome": ["resumed"]})
            return
        until = max([*([state.get[0]] if state.exists else []), *(int(t.timestamp() * 1000) for f in frames for t in f.resume_at)])
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [], "outcome": []}).astype("object")

    ship(runs.sparkSession)
    return runs.withWatermark("entered_at", late).groupBy("run_id").applyInPandasWithState(step, "run_id string, outcome string", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def resumable(pending: DataFrame, versions: DataFrame) -> DataFrame:
    """pending runs (run_id, workflow, version) with `state`: resume where that version is still stored, retired where only others are, gone where none is."""
    known = versions.select("workflow", "version").distinct().withColumn("same", F.lit(True))
    some = versions.select("workflow").distinct().withColumn("some", F.lit(True))
    joined = pending.join(known, ["workflow", "version"], "left").join(some, "workflow", "left")
    return joined.withColumn("state", F.when(F.col("same"), "resume").when(F.col("some"), "retired").otherwise("gone")).drop("same", "some")


#: Items of one iteration; longer ones fail as a whole, none is cut.
ITEMS = 10_000


def iterated(runs: DataFrame, items: str = "items") -> DataFrame:
    """A row for each item of each run: (…, item_no from 0, item, n_items). A run with more than ITEMS fails: one row with `failed` set."""
    n = F.coalesce(F.size(items), F.lit(0))
    kept = F.when(n <= ITEMS, F.col(items))
    rest = [c for c in runs.columns if c != items]
    return runs.select(*rest, n.alias("n_items"), F.when(n > ITEMS, "too-many-items").alias("failed"), F.posexplode_outer(kept).alias("item_no", "item")).where("n_items > 0")


def round_robin(rows: DataFrame, order: list[Column], candidates: list[str], start: int = 0) -> DataFrame:
    """rows with `picked`, dealt in turn. Places are counted within range-ordered partitions and offset by their totals, so no task orders all rows."""
    spark = rows.sparkSession
    # Written once: offsets and rows must see one and the same partitioning.
    path = f"{shared_folder(spark)}/recordwell-turns-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)}).write.parquet(path)
    placed = spark.read.parquet(path)
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    names = F.array(*map(F.lit, candidates))
    joined = placed.join(F.broadcast(base), "part")
    turn = F.coalesce("base", F.lit(0)) + F.lit(start) + F.col("place")
    return joined.withColumn("picked", F.get(names, (turn % len(candidates)).cast("int"))).drop("part", "place", "base")


def least_loaded(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """(candidate, load), those with the fewest links first."""
    load = links.groupBy(F.col("target_id").alias("candidate")).agg(F.count(F.lit(1)).alias("load"))
    return candidates.select("candidate").join(load, "candidate", "left").select("candidate", F.coalesce("load", F.lit(0)).alias("load")).orderBy("load", "candidate")


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: sessions of each user by gaps, with watermarked state when streaming."""
    source = events.withWatermark("at", late) if events.isStreaming else events
    return source.groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n", "value")


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An addition: events by type in fixed windows."""
    source = events.withWatermark("at", late) if events.isStreaming else events
    return source.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), "event_type", "n")
