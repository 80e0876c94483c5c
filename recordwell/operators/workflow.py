"""Workflow runs over their graph of steps: which steps run, wait, are skipped or fail.

States of (run, step) form a lattice, from not started to one of the ends, and never go back. So a run is a frontier that moves
over the graph: steps that have just ended tell their children, counts per (run, step) say when all parents have, and
then the child is executed, skipped, or fails safely with them. Each round costs what the frontier holds, over all runs at once, and there are as many
rounds as the longest path has steps.

A step is executed once all its parents ended and one of them succeeded, or failed but is set to continue; else it fails safely
if a parent did, else it is skipped. Behind an IF_ELSE only the chosen branch counts as ended like the step itself, the others as skipped. A
failure that isn't set to continue ends its run: steps of the same round still end, no further one starts. A step without an
outcome waits, and holds up what stands behind it. Steps without parents start only if they are named as starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import kept, ship

SUCCESS, STOPPED, SKIPPED, FAILED_SAFELY, FAILED, PENDING, NOT_STARTED = "SUCCESS", "STOPPED", "SKIPPED", "FAILED_SAFELY", "FAILED", "PENDING", "NOT_STARTED"


def scheduled(runs: DataFrame, steps: DataFrame, edges: DataFrame, starts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, workflow, step, status, round) of every step of every run; round is null for those not started.

    runs: run_id, workflow. steps: workflow, step, continues (after a failure). edges: workflow, parent, child, branch (null for a plain
    one), without those that close loops. starts: workflow, step. outcomes: run_id, step, outcome (SUCCESS, STOPPED or ERROR),
    branch (the one that an IF_ELSE chose). Repeated rows count once; of several outcomes of a step the least stands, by name.
    """
    runs = runs.select("run_id", "workflow").where("run_id is not null").distinct()
    steps = steps.groupBy("workflow", "step").agg(F.bool_or(F.coalesce("continues", F.lit(False))).alias("continues"))
    ends = steps.select("workflow", F.col("step").alias("child"))
    edges = edges.join(steps.select("workflow", F.col("step").alias("parent"), "continues"), ["workflow", "parent"]).join(ends, ["workflow", "child"], "left_semi")
    edges = kept(edges.groupBy("workflow", "parent", "child").agg(F.bool_or(F.col("branch").isNull()).alias("plain"), F.collect_set("branch").alias("branches"), F.first("continues").alias("continues")))
    needs = edges.groupBy("workflow", "child").agg(F.count(F.lit(1)).alias("need"))
    told = outcomes.groupBy("run_id", "step").agg(F.min(F.struct("outcome", "branch")).alias("o")).select("run_id", "step", "o.outcome", "o.branch")

    roots = starts.select("workflow", "step").distinct().join(needs, [starts.workflow == needs.workflow, starts.step == needs.child], "left_anti").join(steps.select("workflow", "step"), ["workflow", "step"], "left_semi")
    now = runs.join(roots, "workflow").select("run_id", "workflow", "step", F.lit("EXECUTE").alias("decision"))
    waiting = now.limit(0).select("run_id", "workflow", F.col("step").alias("child"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("go"), F.lit(False).alias("failed"))
    done, turn = [], 0
    while True:
        status = (
            F.when(F.col("decision") != "EXECUTE", F.col("decision")).when(F.col("outcome") == "ERROR", F.when(F.col("continues"), FAILED_SAFELY).otherwise(FAILED))
            .when(F.col("outcome").isin(SUCCESS, STOPPED), F.col("outcome")).otherwise(PENDING)
        )
        ended = now.join(told, ["run_id", "step"], "left").join(steps, ["workflow", "step"], "left")
        ended = kept(ended.select("run_id", "workflow", "step", status.alias("status"), F.when((F.col("decision") == "EXECUTE") & F.col("outcome").isin(SUCCESS, STOPPED), F.col("branch")).alias("chosen"), (F.col("decision") == "EXECUTE").alias("ran")))
        done.append(ended.select("run_id", "workflow", "step", "status", F.lit(turn).alias("round")))
        stopped = ended.where(F.col("status") == FAILED).select("run_id").distinct()
        passed = ended.where(F.col("status").isin(SUCCESS, STOPPED, SKIPPED, FAILED_SAFELY))
        met = passed.join(edges.withColumnRenamed("parent", "step"), ["workflow", "step"])
        seen = F.when(F.col("plain") | F.col("chosen").isNull() | F.array_contains("branches", F.col("chosen")), F.col("status")).otherwise(SKIPPED)
        met = met.withColumn("as", seen).select(
            "run_id", "workflow", "child", F.lit(1).cast("long").alias("n"), ((F.col("as") == SUCCESS) | ((F.col("as") == FAILED_SAFELY) & F.col("ran") & F.col("continues"))).alias("go"), (F.col("as") == FAILED_SAFELY).alias("failed"),
        )
        counted = waiting.unionByName(met).groupBy("run_id", "workflow", "child").agg(F.sum("n").alias("n"), F.bool_or("go").alias("go"), F.bool_or("failed").alias("failed"))
        counted = kept(counted.join(stopped, "run_id", "left_anti").join(needs, ["workflow", "child"]))
        ready = counted.where("n >= need")
        if ready.isEmpty():
            break
        now = ready.select("run_id", "workflow", F.col("child").alias("step"), F.when(F.col("go"), "EXECUTE").when(F.col("failed"), FAILED_SAFELY).otherwise(SKIPPED).alias("decision"))
        waiting = counted.where("n < need").drop("need")
        turn += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    all_steps = runs.join(steps.select("workflow", "step"), "workflow")
    return all_steps.join(every, ["run_id", "workflow", "step"], "left").select("run_id", "workflow", "step", F.coalesce("status", F.lit(NOT_STARTED)).alias("status"), "round")


def run_states(states: DataFrame) -> DataFrame:
    """(run_id, status): FAILED with a failed step, RUNNING while a step waits, else COMPLETED."""
    failed, waits = F.bool_or(F.col("status") == FAILED), F.bool_or(F.col("status") == PENDING)
    return states.groupBy("run_id").agg(F.when(failed, "FAILED").when(waits, "RUNNING").otherwise("COMPLETED").alias("status"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph, vertex) that edges (graph, src, dst) lead to from starts (graph, vertex), these included: a frontier, written each round."""
    edges = kept(edges.select("graph", "src", "dst").distinct())
    front = kept(starts.select("graph", "vertex").distinct())
    seen = [front]
    while not front.isEmpty():
        known = _union(seen)
        front = kept(front.join(edges, [front.graph == edges.graph, front.vertex == edges.src]).select(front.graph, F.col("dst").alias("vertex")).distinct().join(known, ["graph", "vertex"], "left_anti"))
        seen.append(front)
    return _union(seen)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Rows (edges and what is asked of them) up to which a graph is searched within one row; greater graphs go by rounds over the rows of them all.
WHOLE = 512
#: Types of vertices that Python orders and compares as Spark does.
ORDERED = (T.IntegralType, T.StringType, T.DateType, T.DecimalType, T.BooleanType)
#: Found rows that are handed on at once.
HANDED = 50_000

Pairs = list[tuple[Any, Any]]


def _by_size(*parts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Graphs of few rows, a row each: (graph, part, a, b), the last three arrays; and the parts' rows of all other graphs, those with nulls too.

    parts: rows (graph and two vertices). There are no other graphs where the list is empty.
    """
    every = kept(_union([p.toDF("graph", "a", "b").withColumn("part", F.lit(k)) for k, p in enumerate(parts)]), "graphs")
    odd = F.col("a").isNull() | F.col("b").isNull() | F.col("graph").isNull()
    great = kept(every.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.bool_or(odd).alias("odd")).where(f"odd or n > {WHOLE}").select("graph"), "great")
    rest: list[DataFrame] = []
    few = every
    if not isinstance(every.schema["a"].dataType, ORDERED):
        return _gathered(every.limit(0)), list(parts)
    if not great.isEmpty():
        rows = every.alias("e").join(great.alias("g"), F.col("e.graph").eqNullSafe(F.col("g.graph")), "left_semi")
        rest = [rows.where(F.col("part") == k).select("graph", "a", "b").toDF(*p.columns) for k, p in enumerate(parts)]
        few = every.join(great, "graph", "left_anti").where("graph is not null")
    return _gathered(few), rest


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("graph").agg(*(F.collect_list(c).alias(c) for c in ("part", "a", "b")))


def _searched(few: DataFrame, search: Callable[[list[Pairs]], Iterator[tuple]], parts: int, vertices: list[str], counts: tuple[str, ...] = ()) -> DataFrame:
    """(graph, vertices, counts) that `search` finds in each graph of _by_size, given the pairs of its parts."""
    ship(few.sparkSession)
    graph, vertex = few.schema["graph"].dataType, few.schema["a"].dataType.elementType
    fields = [T.StructField("graph", graph), *(T.StructField(v, vertex) for v in vertices), *(T.StructField(c, T.LongType()) for c in counts)]

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            kinds = [batch.schema.field("graph").type, *[batch.schema.field("a").type.value_type] * len(vertices), *[pa.int64()] * len(counts)]
            out: list[tuple] = []
            for g, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("graph", "part", "a", "b")), strict=True):
                given: list[Pairs] = [[] for _ in range(parts)]
                for k, *pair in zip(part, a, b, strict=True):
                    given[k].append(tuple(pair))
                out += [(g, *row) for row in search(given)]
                if len(out) >= HANDED:
                    yield _batch(out, kinds, fields)
                    out = []
            if out:
                yield _batch(out, kinds, fields)

    return few.mapInArrow(found, T.StructType(fields))


def _batch(rows: list[tuple], kinds: list, fields: list[T.StructField]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.name for f in fields])


def _reach(edges: Pairs) -> tuple[list, list[int]]:
    """The vertices in their order, and for each the set, as bits, of those that a path of one edge or more leads to."""
    names = sorted({v for e in edges for v in e})
    at = {v: k for k, v in enumerate(names)}
    sets = [0] * len(names)
    for a, b in edges:
        sets[at[a]] |= 1 << at[b]
    for k in range(len(sets)):
        bit, beyond = 1 << k, sets[k]
        if beyond:
            sets = [s | beyond if s & bit else s for s in sets]
    return names, sets


def _members(names: list, bits: int) -> list:
    found = []
    while bits:
        low = bits & -bits
        found.append(names[low.bit_length() - 1])
        bits ^= low
    return found


def _closure_of(given: list[Pairs]) -> Iterator[tuple]:
    names, sets = _reach(given[0])
    return ((v, w) for v, bits in zip(names, sets, strict=True) for w in _members(names, bits))


def closure(edges: DataFrame) -> DataFrame:
    """(graph, src, dst): whether a path of one edge or more leads from one vertex to another. The result has a row for each such pair.

    A graph of at most WHOLE edges is searched within its row, so that its pairs aren't moved; of greater ones, the paths' length is doubled each round.
    """
    few, rest = _by_size(edges.select("graph", "src", "dst"))
    found = _searched(few, _closure_of, 1, ["src", "dst"])
    return found.union(_closure_by_rounds(rest[0])) if rest else found


def _closure_by_rounds(edges: DataFrame) -> DataFrame:
    now = kept(edges.select("graph", "src", "dst").distinct())
    size = now.count()
    while True:
        left, right = now.alias("l"), now.alias("r")
        longer = left.join(right, (F.col("l.graph") == F.col("r.graph")) & (F.col("l.dst") == F.col("r.src"))).select("l.graph", "l.src", "r.dst")
        now = kept(now.union(longer).distinct())
        before, size = size, now.count()
        if size == before:
            return now


def _components_of(given: list[Pairs]) -> Iterator[tuple]:
    """Vertices on a cycle reach each other if they reach the same set."""
    names, sets = _reach(given[0])
    rings: dict[int, list] = {}
    for k, bits in enumerate(sets):
        if bits >> k & 1:
            rings.setdefault(bits, []).append(names[k])
        else:
            yield names[k], names[k], 1
    for ring in rings.values():
        yield from ((v, ring[-1], len(ring)) for v in ring)


def strong_components(edges: DataFrame) -> DataFrame:
    """(graph, vertex, component, size) of the directed edges (graph, src, dst): vertices that reach each other, named by the greatest.

    A graph of at most WHOLE edges is searched within its row. Of greater ones, vertices without an edge in or out are trimmed, round
    by round, as components of their own. Then each vertex is coloured by the greatest vertex that reaches it, over edges and over colours found
    so far, so that long paths take few rounds; and whatever reaches the vertex that gave the colour, within the colour, is its
    component. What is left starts anew.
    """
    few, rest = _by_size(edges.select("graph", "src", "dst"))
    found = _searched(few, _components_of, 1, ["vertex", "component"], ("size",))
    return found.union(_components_by_rounds(rest[0])) if rest else found


def _components_by_rounds(edges: DataFrame) -> DataFrame:
    left = kept(edges.select("graph", "src", "dst").distinct())
    names = kept(left.select("graph", F.col("src").alias("vertex")).union(left.select("graph", "dst")).distinct())
    found: list[DataFrame] = []
    left = left.where("src <> dst")
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colour = _coloured(left)
        tinted = left.join(colour.withColumnsRenamed({"vertex": "src", "colour": "a"}), ["graph", "src"]).join(colour.withColumnsRenamed({"vertex": "dst", "colour": "b"}), ["graph", "dst"])
        inside = kept(tinted.where("a = b").select("graph", "src", "dst", F.col("a").alias("colour")))
        front = kept(inside.where("dst = colour").select("graph", F.col("dst").alias("vertex"), "colour").distinct())
        members = [colour.where("vertex = colour").select("graph", "vertex", "colour")]
        seen = kept(members[0])
        while not front.isEmpty():
            back = inside.join(front.select("graph", F.col("vertex").alias("dst"), "colour"), ["graph", "dst", "colour"]).select("graph", F.col("src").alias("vertex"), "colour").distinct()
            front = kept(back.join(seen, ["graph", "vertex", "colour"], "left_anti"))
            seen = seen.union(front)
        part = kept(seen.select("graph", "vertex", F.col("colour").alias("component")))
        found.append(part)
        gone = part.select("graph", "vertex")
        left = kept(left.join(gone.withColumnRenamed("vertex", "src"), ["graph", "src"], "left_anti").join(gone.withColumnRenamed("vertex", "dst"), ["graph", "dst"], "left_anti").select("graph", "src", "dst"))
    every = _union(found) if found else names.limit(0).withColumn("component", F.col("vertex"))
    whole = names.join(every, ["graph", "vertex"], "left").select("graph", "vertex", F.coalesce("component", "vertex").alias("component"))
    sizes = whole.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size"))
    return whole.join(sizes, ["graph", "component"]).select("graph", "vertex", "component", "size")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between vertices that, time after time, have edges both in and out."""
    size = edges.count()
    while size:
        into, out = edges.select("graph", F.col("dst").alias("v")).distinct(), edges.select("graph", F.col("src").alias("v")).distinct()
        edges = kept(edges.join(into.withColumnRenamed("v", "src"), ["graph", "src"], "left_semi").join(out.withColumnRenamed("v", "dst"), ["graph", "dst"], "left_semi").select("graph", "src", "dst"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(graph, vertex, colour): the greatest vertex that reaches each one, itself included."""
    vertices = edges.select("graph", F.col("src").alias("vertex")).union(edges.select("graph", "dst")).distinct()
    now = kept(vertices.select("graph", "vertex", F.col("vertex").alias("colour")))
    while True:
        met = edges.join(now.withColumnRenamed("vertex", "src"), ["graph", "src"]).select("graph", F.col("dst").alias("vertex"), "colour")
        # The colour's own colour reaches the vertex, too.
        far = now.alias("v").join(now.alias("c"), (F.col("v.graph") == F.col("c.graph")) & (F.col("v.colour") == F.col("c.vertex"))).select("v.graph", "v.vertex", "c.colour")
        new = kept(now.unionByName(met).unionByName(far).groupBy("graph", "vertex").agg(F.max("colour").alias("colour")))
        changed = not new.join(now, ["graph", "vertex", "colour"], "left_anti").isEmpty()
        now = new
        if not changed:
            return now


def loop_bodies(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(graph, loop, vertex): the steps of each loop's body: what its first steps (graph, loop, vertex) lead to without passing the loop's own step."""
    few, rest = _by_size(edges.select("graph", "src", "dst"), first.select("graph", "loop", "vertex"))
    found = _searched(few, _bodies_of, 2, ["loop", "vertex"])
    return found.union(_bodies_by_rounds(*rest)) if rest else found


def _bodies_of(given: list[Pairs]) -> Iterator[tuple]:
    after: dict[Any, set] = {}
    for a, b in given[0]:
        after.setdefault(a, set()).add(b)
    bodies: dict[Any, set] = {}
    for loop, vertex in given[1]:
        bodies.setdefault(loop, set()).add(vertex)
    for loop, body in bodies.items():
        front = body = body - {loop}
        while front:
            front = {w for v in front for w in after.get(v, ())} - body - {loop}
            body = body | front
        yield from ((loop, v) for v in body)


def _bodies_by_rounds(edges: DataFrame, first: DataFrame) -> DataFrame:
    edges = kept(edges.select("graph", "src", "dst").distinct())
    front = kept(first.select("graph", "loop", "vertex").where("vertex <> loop").distinct())
    seen = [front]
    while not front.isEmpty():
        step = front.alias("f").join(edges.alias("e"), (F.col("f.graph") == F.col("e.graph")) & (F.col("f.vertex") == F.col("e.src"))).select("f.graph", "f.loop", F.col("e.dst").alias("vertex"))
        front = kept(step.where("vertex <> loop").distinct().join(_union(seen), ["graph", "loop", "vertex"], "left_anti"))
        seen.append(front)
    return _union(seen)


def closing_edges(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """The edges by which a loop's body returns to its step: those that scheduling leaves out, and that are no fault."""
    body = bodies.select("graph", F.col("vertex").alias("src"), F.col("loop").alias("dst"))
    return edges.select("graph", "src", "dst").distinct().join(body, ["graph", "src", "dst"], "left_semi")


def faulty_cycles(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """(graph, vertex, component, size) of steps on a cycle that closes no loop; a step that leads to itself is one."""
    rest = edges.select("graph", "src", "dst").distinct().join(closing_edges(edges, bodies), ["graph", "src", "dst"], "left_anti")
    own = rest.where("src = dst").select("graph", F.col("src").alias("vertex"), F.lit(True).alias("own"))
    return strong_components(rest).join(own, ["graph", "vertex"], "left").where("size > 1 or own").drop("own")
