import numpy as np
import pytest
from pyspark.sql import functions as F

from recordwell.llm import ann_blocks, hnsw

NAN, INF = float("nan"), float("inf")


def brute_nearest(rows, k, asked):
    sound = {i: np.array(v, float) for i, v, *_ in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q in sound:
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(sound[q], c, strict=True)), i) for i, c in sound.items() if i != q and len(c) == len(sound[q]))[:k]
            out |= {(q, n, i) for n, (_, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("tile", [8192, 40])
def test_nearest_equals_brute_force(spark, tile):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ann_blocks.nearest(df, F.col("vec_id") % 20 == 0, tile=tile).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute_nearest(rows, 20, lambda q: q % 20 == 0)
    vectors = dict(rows)
    assert all(abs(r.score - sum(np.float64(a) * np.float64(b) for a, b in zip(vectors[r.query_id], vectors[r.vec_id], strict=True))) < 1e-12 for r in got)


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [NAN, 1.0]), (80, [None, 1.0]), (100, [INF, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, -1.0]), (None, [1.0, 1.0]), (120, []), (140, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, score string, dim int")
    got = [tuple(r) for r in ann_blocks.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 3, 1.0)]
    assert ann_blocks.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_links(rows, least=0.93):
    sound = [(i, np.array(v, float), l) for i, v, l in rows if v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (i, x, l) in enumerate(sound):
        for j, y, m in sound[a + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[i] += 1
                n[j] += 1
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], top(i)) for i in n}


@pytest.mark.parametrize("shard", [4096, 64])
def test_links_equal_brute_force(spark, shard):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for k in range(400):
        v = centres[k % 6] + rng.normal(size=16) * (0.08 if k % 5 else 1.5)
        rows.append((k, (v if k % 11 else centres[k % 6]).astype("f4").tolist(), k % 6 // 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, shard=shard, chunk=100).collect()}
    want = brute_links(rows)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and sum(got[k][1] != want[k][1] for k in want) == 0


def test_links_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [NAN, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [0.5, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "vec_id long, embedding array<double>, label int, part int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    assert [got[k] for k in (1, 2, 3, 12)] == [(3, 1, True), (3, 1, False), (3, 1, False), (3, 1, False)]
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, True)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def groups(copies: int, spread: float, n: int = 4000, dim: int = 64) -> np.ndarray:
    rng = np.random.default_rng(copies)
    return (np.repeat(rng.normal(size=(n // copies, dim)), copies, 0) + spread * rng.normal(size=(n // copies * copies, dim)))[rng.permutation(n // copies * copies)]


def degrees(x: np.ndarray, least: float = 0.93) -> np.ndarray:
    u = hnsw.unit(x)
    hit = u @ u.T >= least
    np.fill_diagonal(hit, False)
    return hit.sum(1)


@pytest.mark.parametrize(("copies", "spread", "vertices"), [(1, 0.0, 4000), (2, 0.2, 4000), (20, 0.15, 2500), (400, 0.03, 20), (4000, 0.03, 20), (400, 0.2, 4000)])
def test_graph_search_alone_finds_the_links(copies, spread, vertices):
    """No query is left to the block product, the graph holds few vertices for near copies, and the links are found."""
    x = groups(copies, spread)
    ids, ones = np.arange(len(x)) * 3, np.ones(len(x), np.int64)
    graph = hnsw.Graph.unpacked(hnsw.unit(x), hnsw.Graph.build(hnsw.unit(x), 0.93).packed())
    assert len(graph.x) <= vertices
    a, _, dense, audit = hnsw.reached(graph, hnsw.unit(x), 0.93)
    assert len(dense) == 0 and audit["missed"] == 0 and audit["truth"] >= 32 and len(np.unique(a)) == len(x)
    assert copies == 400 or len(a) <= 30 * len(x)
    got, u, v = hnsw.counted(graph, x, ids, ones, x, ids, 0.93)
    want = degrees(x)
    assert got.sum() >= 0.99 * want.sum() and (got <= want).all()
    assert len(u) <= len(x)


def test_long_answers_come_from_block_products():
    """A label of which all vectors are linked, though none is near another: too long an answer for a beam."""
    x = groups(3000, 0.2, 3000)
    ids, ones = np.arange(len(x)), np.ones(len(x), np.int64)
    graph = hnsw.Graph.build(hnsw.unit(x), 0.93)
    assert len(hnsw.reached(graph, hnsw.unit(x), 0.93)[2]) == len(x)
    got, u, v = hnsw.counted(graph, x, ids, ones, x, ids, 0.93)
    assert (got == degrees(x)).all() and (v == 0).all() and len(u) == len(x) - 1


def test_an_audit_that_fails_leads_to_the_block_product():
    x = groups(2, 0.2, 2000)
    ids, ones = np.arange(len(x)), np.ones(len(x), np.int64)
    graph = hnsw.Graph.build(hnsw.unit(x), 0.93)
    graph.layers = [np.full_like(g, -1) for g in graph.layers]  # no links: searches end where they start
    assert hnsw.reached(graph, hnsw.unit(x), 0.93)[3]["missed"] > 0
    assert (hnsw.counted(graph, x, ids, ones, x, ids, 0.93)[0] == degrees(x)).all()


def test_weights_and_magnitudes():
    """Copies weigh, members count through their vertex, huge and tiny vectors have their cosine."""
    x = groups(50, 0.03, 1000) * np.exp2(np.random.default_rng(3).integers(-1020, 1020, (1000, 1)).astype(float))
    ids, copies = np.arange(len(x)), np.random.default_rng(4).integers(1, 9, len(x))
    u = hnsw.unit(x)
    hit = u @ u.T >= 0.93
    np.fill_diagonal(hit, False)
    got = hnsw.counted(hnsw.Graph.build(u, 0.93), x, ids, copies, x, ids, 0.93)[0]
    assert (got == hit @ copies).all()


def test_links_over_shards_and_chunks(spark):
    """Labels of some thousand vectors in several shards: pairs, groups and near copies, against brute force."""
    parts = [(0, groups(2, 0.2, 3000)), (1, groups(20, 0.1, 1500)), (2, groups(400, 0.03, 1600))]
    rows = [(k, v.astype("f4"), label) for k, (label, v) in enumerate((label, v) for label, x in parts for v in x)]
    df = spark.createDataFrame([(k, v.tolist(), label) for k, v, label in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, shard=1200, chunk=700).collect()}
    for label, x in parts:
        ids = [k for k, _, at in rows if at == label]
        u = hnsw.unit(np.array([rows[k][1] for k in ids], float))
        hit = u @ u.T >= 0.93
        np.fill_diagonal(hit, False)
        assert [got[k][0] for k in ids] == hit.sum(1).tolist()
        root = hnsw.stars(len(ids), *np.nonzero(hit))
        assert [got[k][1] for k in ids] == [ids[r] for r in root]


def test_graph_finds_the_nearest():
    x = hnsw.unit(np.random.default_rng(0).normal(size=(3000, 32)))
    graph = hnsw.Graph.unpacked(x, hnsw.Graph.build(x).packed())
    assert len(graph.layers) > 1
    ids, _ = graph.search(x[:200], 64)
    exact = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(exact, ids, strict=True)]) >= 0.9


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(50, 24)), rng.normal(size=(300, 24)) * rng.uniform(0.01, 50, (300, 1))
    (qc, qs, qn, qe), (cc, cs, cn, ce) = ann_blocks.coded(q), ann_blocks.coded(c)
    near = (qc @ cc.T) * (qs[:, None] * cs)
    slack = qn[:, None] * ce + qe[:, None] * np.linalg.norm(c, axis=1)
    assert (np.abs(near - q @ c.T) <= slack * (1 + 1e-9)).all()


@pytest.mark.parametrize("dim", [1040, 4096])
def test_quantisation_bounds_hold_for_long_vectors(dim):
    """Codes all near 127 make the largest sums: they must still be exact, and no true neighbour pruned."""
    rng = np.random.default_rng(dim)
    q, c = 1 + 1e-3 * rng.normal(size=(20, dim)), 1 + 1e-3 * rng.normal(size=(200, dim))
    (qc, *_), (cc, *_) = ann_blocks.coded(q), ann_blocks.coded(c)
    assert (ann_blocks.code_products(qc, cc) == qc.astype(np.int64) @ cc.astype(np.int64).T).all()
    found = list(ann_blocks.best_in_tile(np.arange(20), q, 100 + np.arange(200), c, 5))
    exact = np.array([ann_blocks.products(np.repeat(x[None], 200, 0), c) for x in q])
    for k in range(20):
        got = [b for ids, near, _ in found for a, b in zip(ids, near, strict=True) if a == k]
        assert got == [100 + j for j in np.lexsort((np.arange(200), -exact[k]))[:5]]


def test_nearest_of_extreme_magnitudes(spark):
    """Denormal, tiny and huge components; an id with vectors of two lengths takes part once a length."""
    vectors = {0: [5e-324, 0.0], 20: [1e200, 1e200], 1: [1.0, 2.0], 2: [-3e-310, 4e-310], 3: [1e300, 1e10], 4: [2e-200, 3.0]}
    rows = [*vectors.items(), (5, [1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (40, [0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_blocks.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    wide = {**vectors, 5: [1.0, 1.0]}
    want = []
    for q in (0, 20):
        with np.errstate(over="ignore"):
            score = {i: ann_blocks.products(np.array([wide[q]]), np.array([v]))[0] for i, v in wide.items() if i != q}
        want += [(q, n, i) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:3], 1)]
    assert got == [*want, (40, 1, 5)]
