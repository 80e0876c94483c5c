"""Scheduling and graphs of steps against plain Python."""

import random

from recordwell.operators import workflow

RUN, STEP, EDGE, OUT = "run_id long, workflow string", "workflow string, step string, continues boolean", "workflow string, parent string, child string, branch string", "run_id long, step string, outcome string, branch string"


def states(spark, steps, edges, starts, outcomes, runs=((1, "w"),)):
    frames = [spark.createDataFrame(list(r), kind) for r, kind in ((runs, RUN), (steps, STEP), (edges, EDGE), ([("w", s) for s in starts], "workflow string, step string"), (outcomes, OUT))]
    return {(r.run_id, r.step): r.status for r in workflow.scheduled(*frames).collect()}


def plain(steps, edges, starts, told):
    """One run, round by round, from the rules."""
    parents = {s: sorted({p for p, c, _ in edges if c == s and p in steps}) for s in steps}
    status, chosen, ran = dict.fromkeys(steps, "NOT_STARTED"), {}, set()

    def execute(s):
        outcome, branch = told.get(s, (None, None))
        ran.add(s)
        status[s] = {"ERROR": "FAILED_SAFELY" if steps[s] else "FAILED", "SUCCESS": "SUCCESS", "STOPPED": "STOPPED"}.get(outcome, "PENDING")
        if status[s] in ("SUCCESS", "STOPPED"):
            chosen[s] = branch

    def seen(p, s):
        between = [b for x, c, b in edges if (x, c) == (p, s)]
        return status[p] if None in between or chosen.get(p) is None or chosen[p] in between else "SKIPPED"

    ready = [s for s in starts if s in steps and not parents[s]]
    decided = dict.fromkeys(ready, "EXECUTE")
    while decided:
        for s, what in decided.items():
            if what == "EXECUTE":
                execute(s)
            else:
                status[s] = what
        decided = {}
        if "FAILED" in status.values():
            break
        for s in steps:
            if status[s] == "NOT_STARTED" and parents[s]:
                saw = [(seen(p, s), p) for p in parents[s]]
                if all(x in ("SUCCESS", "STOPPED", "SKIPPED", "FAILED_SAFELY") for x, _ in saw):
                    go = any(x == "SUCCESS" or x == "FAILED_SAFELY" and p in ran and steps[p] for x, p in saw)
                    decided[s] = "EXECUTE" if go else "FAILED_SAFELY" if any(x == "FAILED_SAFELY" for x, _ in saw) else "SKIPPED"
    return status


def test_branches_failures_and_waits(spark):
    steps = [("w", s, s == "c") for s in "abcdef"] + [("w", "a", None), ("other", "z", False)]
    edges = [("w", "a", "b", "yes"), ("w", "a", "c", "no"), ("w", "b", "d", None), ("w", "c", "d", None), ("w", "c", "e", None), ("w", "d", "f", None), ("w", "c", "e", None), ("w", "c", "gone", None)]
    runs = [(k, "w") for k in range(1, 6)] + [(1, "w"), (None, "w"), (9, "other"), (10, None)]
    ok = lambda run, *names: [(run, s, "SUCCESS", None) for s in names]
    outcomes = [*ok(1, *"bdf"), (1, "a", "SUCCESS", "yes"), (2, "a", "SUCCESS", "no"), (2, "c", "ERROR", None), *ok(2, *"def"), (3, "a", "ERROR", None), (4, "a", "SUCCESS", "neither"), (5, "a", "STOPPED", None), (5, "a", "STOPPED", None)]
    got = states(spark, steps, edges, ["a", "b", "nowhere"], outcomes, runs)
    of = lambda run: "".join({"SUCCESS": "s", "STOPPED": "h", "SKIPPED": "-", "FAILED_SAFELY": "~", "FAILED": "X", "PENDING": "?", "NOT_STARTED": "."}[got[run, s]] for s in "abcdef")
    # c fails but goes on, so d and e run; without a chosen branch all are skipped; what is stopped runs nothing behind it.
    assert [of(k) for k in range(1, 6)] == ["ss-s-s", "s-~sss", "X.....", "s-----", "h-----"]
    assert got[9, "z"] == "NOT_STARTED" and len(got) == 5 * 6 + 1
    assert states(spark, [], [], [], [], []) == {}


def test_random_graphs_equal_plain_rounds(spark):
    r = random.Random(4)
    names = "abcdefghij"
    steps = {s: r.random() < 0.3 for s in names}
    edges = [(p, c, r.choice([None, None, "x", "y"])) for k, p in enumerate(names) for c in names[k + 1 :] if r.random() < 0.35]
    starts = ["a", "b", "c", "j"]
    told = {run: {s: (r.choice(["SUCCESS"] * 6 + ["STOPPED", "ERROR", None]), r.choice(["x", "y", None])) for s in names} for run in range(60)}
    got = states(spark, [("w", *x) for x in steps.items()], [("w", *e) for e in edges], starts, [(run, s, *o) for run, of in told.items() for s, o in of.items() if o[0]], [(run, "w") for run in told])
    for run, of in told.items():
        want = plain(steps, edges, starts, of)
        assert {s: got[run, s] for s in names} == want


def test_small_graphs_are_searched_in_their_rows(spark, monkeypatch):
    r = random.Random(11)
    edges = [(g, r.choice("abcdefgh"), r.choice("abcdefgh")) for g in range(40) for _ in range(r.randrange(1, 14))] + [(50, "a", None), (50, "a", "b"), (50, "b", "a")]
    df = spark.createDataFrame(edges, "graph long, src string, dst string")
    first = spark.createDataFrame([(g, r.choice("abcdefgh"), r.choice("abcdefgh")) for g in range(45) for _ in range(3)], "graph long, loop string, vertex string")
    told = lambda: [sorted(map(tuple, x.collect()), key=repr) for x in (workflow.closure(df), workflow.strong_components(df), workflow.loop_bodies(df, first))]
    rounds: list[int] = []
    for name in ("_closure_by_rounds", "_components_by_rounds", "_bodies_by_rounds"):
        monkeypatch.setattr(workflow, name, lambda *frames, was=getattr(workflow, name): rounds.append(frames[0].select("graph").distinct().count()) or was(*frames))
    within = told()
    assert rounds == [1, 1, 1]  # the graph with a null alone
    monkeypatch.setattr(workflow, "WHOLE", 8)
    mixed = told()
    monkeypatch.setattr(workflow, "ORDERED", ())
    assert within == mixed == told() and rounds[3] > 1 and rounds[6] == 41


def test_components_closure_and_loops(spark):
    r = random.Random(7)
    edges = [(g, r.randrange(9), r.randrange(9)) for g in (1, 2, 3) for _ in range(14)] + [(4, 1, 1), (5, 1, 2), (5, 2, 3), (6, 1, 2), (6, 2, 1), (6, 2, 1)]
    edges += [(7, k + 1, k) for k in range(40)] + [(7, 0, 40)]  # one long cycle against the order of names
    df = spark.createDataFrame(edges, "graph long, src long, dst long")
    reach = {}
    for g, a, b in edges:
        reach.setdefault(g, set()).add((a, b))
    for g, pairs in reach.items():
        while True:
            more = {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs
            if not more:
                break
            pairs |= more
    assert {tuple(x) for x in workflow.closure(df).collect()} == {(g, a, b) for g, pairs in reach.items() for a, b in pairs}
    got = {(x.graph, x.vertex): (x.component, x.size) for x in workflow.strong_components(df).collect()}
    for g, pairs in reach.items():
        for v in {x for e in edges if e[0] == g for x in e[1:]}:
            same = {v} | {b for a, b in pairs if a == v and (b, a) in pairs}
            assert got[g, v] == (max(same), len(same))
    # a step's loop: 1 leads into 2, 3 and back; 3 to 5 is out of the loop's ring, but part of its body.
    loop = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 5), (1, 5, 6), (1, 6, 5), (1, 1, 9), (1, 7, 7)], "graph long, src long, dst long")
    bodies = workflow.loop_bodies(loop, spark.createDataFrame([(1, 1, 2), (1, 1, 1)], "graph long, loop long, vertex long"))
    assert sorted(x.vertex for x in bodies.collect()) == [2, 3, 5, 6]
    assert [tuple(x) for x in workflow.closing_edges(loop, bodies).collect()] == [(1, 3, 1)]
    assert sorted((x.vertex, x.size) for x in workflow.faulty_cycles(loop, bodies).collect()) == [(5, 2), (6, 2), (7, 1)]
    assert sorted(x.vertex for x in workflow.reachable(loop, spark.createDataFrame([(1, 3)], "graph long, vertex long")).collect()) == [1, 2, 3, 5, 6, 9]
    none = loop.limit(0)
    assert workflow.strong_components(none).count() == workflow.closure(none).count() == workflow.reachable(none, bodies.select("graph", "vertex").limit(0)).count() == 0
