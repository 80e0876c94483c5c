"""The named queries, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..schema import Model, ObjectType
from .filters import matching
from .relations import edges
from .sorting import page
from .timeline import tail


def find(records: DataFrame, of: ObjectType, context: Context, where=None, sort=None, limit: int = 50, offset: int = 0, include_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(total, page): how many records match, and one page of them."""
    live = records if include_deleted else records.where("crm_deleted_at is null")
    hit = matching(live, of, where, context)
    return hit.agg(F.count(F.lit(1)).alias("total")), page(hit, of, sort, limit, offset)


def get(model: Model, records: dict[str, DataFrame], events: DataFrame, name: str, record_id: str, most_events: int = 200) -> dict[str, DataFrame]:
    """One record, the links that come in, and its last events."""
    incoming = edges(model, records).where((F.col("target_object") == name) & (F.col("target_id") == record_id))
    own = events.where((F.col("object") == name) & (F.col("record_id") == record_id))
    return {"record": records[name].where(F.col("crm_id") == record_id), "incoming": incoming.select("source_object", "field", "source_id"), "events": tail(own, [F.col("at"), F.col("seq")], most_events)}


def timeline(events: DataFrame, records: DataFrame, since=None, name: str | None = None, record_id: str | None = None, limit: int = 200) -> DataFrame:
    """The last events with their records' current titles."""
    rows = events
    for column, wanted in (("object", name), ("record_id", record_id)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    last = tail(rows, [F.col("at"), F.col("seq")], limit)
    titles = records.select(F.col("crm_id").alias("record_id"), F.col("crm_title").alias("title"))
    return last.join(titles, "record_id", "left")


def run_list(summaries: DataFrame, workflow: str | None = None, status: str | None = None, since=None, limit: int = 50) -> DataFrame:
    """Runs, newest first; CANCELLED is another word for STOPPED."""
    rows = summaries
    if workflow is not None:
        rows = rows.where(F.col("workflow") == workflow)
    if status is not None:
        rows = rows.where(F.col("status") == {"CANCELLED": "STOPPED"}.get(status.upper(), status.upper()))
    if since is not None:
        rows = rows.where(F.col("logged_at") >= since)
    return rows.orderBy(F.col("logged_at").desc(), "run_id").limit(limit)
