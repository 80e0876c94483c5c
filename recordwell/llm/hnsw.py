"""Near-duplicate vectors of one label: navigable small-world graphs per shard, then exact cosine.

Equal vectors of a label are one class with a weight. Each label's classes are dealt by hash to
shards of up to SHARD vectors, so most labels are one shard; a task builds each shard's layered graph and
writes it. A vector that the growing graph shows to lie within half the linking angle of a vertex
joins that vertex as a member instead of becoming one: a group of near copies is a few vertices,
and any two members of a vertex are linked, as their angle is at most the linking angle.

Every class then queries every shard of its label, in chunks: a beam search down the layers, wide enough for
vertices whose members can be linked. Where all of a beam is near enough, the answer goes on by a walk over the links
from vertex to vertex within reach, however long it is. AUDITED queries of each SLICE of a chunk, the first by hash,
are compared with brute force; if they miss a vertex, the beams of all queries whose answer still grows are doubled,
until the audit passes. A query within reach of more than a DENSE-th of a shard's vertices is
answered by a block product, which costs no more than DENSE times reading its answer. So are the queries of a slice if beams as
wide as the shard don't pass the audit, that is, if the graph isn't connected: the last resort.

Vertices whose members all are linked by the triangle inequality of angles count at once; all other pairs are confirmed
by their cosine in double precision. A task returns each class's number of links and a star
forest of its components, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or
without a label, link with nothing: n_links 0, a component of their own. So do null ids (component
null, kept). Vectors of different length don't link. Rows that repeat a vec_id are copies like
others: each counts. Vectors of any magnitude are scaled by a power of two first, so norms never overflow.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .ann_blocks import products, usable
from .components import components
from .shared import written

#: Vectors and numbers of a shard, at most about; the same of a chunk of queries.
SHARD, SHARD_NUMBERS = 32_768, 4_000_000
CHUNK, CHUNK_NUMBERS = 8192, 1_000_000
#: Links of a vertex on the upper layers and on the lowest, and the beam of construction.
M, M0, BUILD_BEAM = 12, 16, 32
#: Queries searched together, those of a slice, and those of it that are audited; the first beam; the part of a shard that makes an answer dense.
TOGETHER, SLICE, AUDITED, BEAM, DENSE = 256, 1024, 32, 48, 8
#: Pairs confirmed at once.
STRIP = 65_536


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so the largest component of each is about one: cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` best vertices met and their products, best first (-1 where there are fewer).

    x, links: vectors and neighbours (padded by -1) of the layer; entry: a row of start vertices a query.
    """
    n, rows = len(x), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True  # the place of padding
    ids = np.full((len(q), beam), -1, np.int32)
    near = np.full((len(q), beam), -np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    fresh = entry
    wide = max(1, beam // 12)
    live = np.arange(len(q))
    while len(live):
        at = rows[: len(live)]
        new = np.sort(np.where(fresh < 0, n, fresh), axis=1)
        twice = np.zeros(new.shape, bool)
        twice[:, 1:] = new[:, 1:] == new[:, :-1]
        new[seen[live[:, None], new] | twice] = n
        seen[live[:, None], new] = True
        value = np.where(new < n, np.matmul(x[np.minimum(new, n - 1)], q[live][:, :, None])[:, :, 0], -np.inf)
        all_near, all_ids = np.concatenate([near[live], value], 1), np.concatenate([ids[live], new], 1)
        all_done = np.concatenate([done[live], new == n], 1)
        order = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam] if all_near.shape[1] > beam else np.arange(beam)[None].repeat(len(live), 0)
        near[live], ids[live], done[live] = all_near[at, order], all_ids[at, order], all_done[at, order]
        open_near = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-open_near, wide - 1, axis=1)[:, :wide]
        works = open_near[at, pick] > -np.inf
        some = works.any(1)
        chosen = np.where(works, ids[live][at, pick], n)
        mark = done[live]
        mark[at, pick] = True
        done[live] = mark
        live, chosen = live[some], chosen[some]
        padded = np.where(chosen < n, chosen, 0)
        fresh = np.where((chosen < n)[:, :, None], links[padded], -1).reshape(len(live), wide * links.shape[1])
    order = np.argsort(-near, axis=1, kind="stable")
    near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
    return np.where(near > -np.inf, ids, -1), near


def diverse(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to the vertex than to a chosen one; then the best of the rest."""
    k = ids.shape[1]
    v = x[np.maximum(ids, 0)]
    mutual = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    for j in range(k):
        blocked = (np.where(chosen[:, :j], mutual[:, j, :j], -np.inf).max(1, initial=-np.inf) > near[:, j]) if j else np.zeros(len(ids), bool)
        chosen[:, j] = (ids[:, j] >= 0) & ~blocked & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def apart(x: np.ndarray, join: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch in order: the rows that become vertices, and for each row the one that it is or joins."""
    owner = np.arange(len(x))
    near = np.triu(x @ x.T >= join, 1)
    for k in np.flatnonzero(near.any(1)):
        if owner[k] == k:
            owner[near[k] & (owner == np.arange(len(x)))] = k
    return np.flatnonzero(owner == np.arange(len(x))), owner


def layer_graph(x: np.ndarray, most: int, join: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, owner, links) of one layer, vectors inserted in growing batches.

    vertices: rows of x; owner: each row's vertex, as a place in vertices; links: neighbour lists as such places.
    A row whose product with a vertex reaches `join` joins it.
    """
    vertices, owner = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    v, links = np.empty_like(x), np.full((len(x), most), -1, np.int32)
    n = at = 0
    while at < len(x):
        batch = np.arange(at, min(len(x), at + min(TOGETHER, max(128, n))))
        at = batch[-1] + 1
        ids, near = np.zeros((len(batch), 0), np.int32), np.zeros((len(batch), 0), np.float32)
        if n:
            entry = np.random.default_rng(at).integers(0, n, (len(batch), 8)).astype(np.int32)
            ids, near = beam_search(v[:n], links[:n], x[batch], entry, BUILD_BEAM)
            joins = near[:, 0] >= join
            owner[batch[joins]] = ids[joins, 0]
            batch, ids, near = batch[~joins], ids[~joins], near[~joins]
        first, joined = apart(x[batch], join)
        new = n + np.arange(len(first))
        owner[batch] = n + np.searchsorted(first, joined)
        vertices[new], v[new] = batch[first], x[batch[first]]
        ids, near, n = ids[first], near[first], n + len(first)
        if not len(new):
            continue
        own = v[new] @ v[new].T  # the others of the batch
        np.fill_diagonal(own, -np.inf)
        best = np.argsort(-own, axis=1, kind="stable")[:, : max(most, BUILD_BEAM if ids.shape[1] == 0 else most)]
        ids, near = np.concatenate([ids, new[best].astype(np.int32)], 1), np.concatenate([near, np.take_along_axis(own, best, 1)], 1)
        ids[np.isneginf(near)] = -1
        order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
        links[new] = diverse(v, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), most)
        _link_back(v, links, new, most)
    return vertices[:n], owner, links[:n]


def _link_back(v: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
    """Offer each new vertex to those that it links to, which keep the best of old and offered ones."""
    back = np.stack([links[new].ravel(), np.repeat(new, most)], 1)
    back = back[back[:, 0] >= 0]
    if not len(back):
        return
    back = back[np.lexsort((-np.einsum("ij,ij->i", v[back[:, 0]], v[back[:, 1]]), back[:, 0]))]
    target, first = np.unique(back[:, 0], return_index=True)
    place = np.arange(len(back)) - np.repeat(first, np.diff(np.r_[first, len(back)]))
    offered = np.full((len(target), most), -1, np.int32)
    keep = place < most
    offered[np.searchsorted(target, back[keep, 0]), place[keep]] = back[keep, 1]
    both = np.sort(np.concatenate([links[target], offered], 1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    value = np.where(both >= 0, np.matmul(v[np.maximum(both, 0)], v[target][:, :, None])[:, :, 0], -np.inf)
    order = np.argsort(-value, axis=1, kind="stable")
    links[target] = diverse(v, np.take_along_axis(both, order, 1), np.take_along_axis(value, order, 1), most)


def connected(links: np.ndarray, entry: int, spare: int = 4) -> np.ndarray:
    """The links with a few columns more, by which searches from the first `entry` vertices reach all: pruning may cut a vertex off.

    Each vertex that isn't reached is linked to from one of its own neighbours.
    """
    n = len(links)
    links = np.pad(links, ((0, 0), (0, spare)), constant_values=-1)
    while True:
        reach, front = np.zeros(n, bool), np.arange(min(n, entry))
        while len(front):
            reach[front] = True
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~reach[front]]
        added = 0
        for v in np.flatnonzero(~reach):
            for w in links[v, :-spare]:
                free = np.flatnonzero(links[w, -spare:] < 0) if w >= 0 and reach[w] else ()
                if len(free):
                    links[w, links.shape[1] - spare + free[0]] = v
                    reach[v] = True
                    added += 1
                    break
        if not added:
            return links if (links[:, -spare:] >= 0).any() else links[:, :-spare]


class Graph:
    """Layers of one shard. Vertices are ordered so that each layer is a prefix of the next lower one."""

    def __init__(self, x: np.ndarray, vertices: np.ndarray, owner: np.ndarray, layers: list[np.ndarray]):
        self.vertices, self.owner, self.layers = vertices, owner, layers  # layers: the lowest first
        self.exact, self.x = x[vertices], x[vertices].astype(np.float32)
        self.members = np.argsort(owner, kind="stable")
        self.start = np.searchsorted(owner[self.members], np.arange(len(vertices) + 1))
        self.radius = np.zeros(len(vertices))
        for low in range(0, len(x), STRIP):
            angle = angles(x[low : low + STRIP], self.exact[owner[low : low + STRIP]])
            np.maximum.at(self.radius, owner[low : low + STRIP], angle)
        self.radius[np.diff(self.start) == 1] = 0

    @classmethod
    def build(cls, x: np.ndarray, least: float = 2.0) -> Graph:
        """x: unit vectors in an order independent of the data, e.g. by hash; the first 1/M of a layer is the next higher one."""
        join = float(np.cos(np.arccos(least) / 2)) + 1e-5 if least <= 1 else 2.0
        vertices, owner, lowest = layer_graph(x.astype(np.float32), M0, join)
        layers, v = [lowest], x[vertices].astype(np.float32)
        while len(layers[-1]) > 4 * M:
            layers.append(layer_graph(v[: len(layers[-1]) // M], M)[2])
        layers[0] = connected(lowest, len(layers[1]) if len(layers) > 1 else 4)
        return cls(x, vertices, owner, layers)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        top = self.layers[-1]
        entry = np.tile(np.arange(min(4, len(top)), dtype=np.int32), (len(q), 1))
        for links in self.layers[:0:-1]:
            entry, _ = beam_search(self.x[: len(links)], links, q, entry, 8)
        return beam_search(self.x, self.layers[0], q, entry, beam)

    def packed(self) -> bytes:
        parts = [self.vertices[:, None], self.owner[:, None], *self.layers]
        return b"".join(np.array([len(g), g.shape[1]], "<i4").tobytes() + g.astype("<i4").tobytes() for g in parts)

    @classmethod
    def unpacked(cls, x: np.ndarray, data: bytes) -> Graph:
        parts, at = [], 0
        while at < len(data):
            n, m = np.frombuffer(data, "<i4", 2, at)
            parts.append(np.frombuffer(data, "<i4", n * m, at + 8).reshape(n, m))
            at += 8 + 4 * n * m
        return cls(x, parts[0][:, 0], parts[1][:, 0], parts[2:])


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, of unit vectors; near zero from the chord, where the cosine's digits don't suffice."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=1) / 2, 1))


def walked(x: np.ndarray, links: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, bar: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The (query, vertex) pairs within reach that links lead to from such pairs (a, b), over vertices within reach only.

    A query stops once it has `most` of them.
    """
    n, out = len(x), [(a, b)]
    seen, count = np.zeros((len(q), n), bool), np.bincount(a, minlength=len(q))
    seen[a, b] = True
    while len(a):
        near = links[b]
        code = np.unique((a[:, None] * n + near)[near >= 0])
        a, b = code // n, code % n
        fresh = ~seen[a, b] & (count[a] < most)
        a, b = a[fresh], b[fresh]
        seen[a, b] = True
        hit = np.concatenate([np.einsum("ij,ij->i", x[b[k : k + STRIP]], q[a[k : k + STRIP]]) >= bar for k in range(0, len(a), STRIP)] or [np.zeros(0, bool)])
        a, b = a[hit], b[hit]
        count += np.bincount(a, minlength=len(q))
        out.append((a, b))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def reached(graph: Graph, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(query, vertex) pairs that may hold links: products of about `least` or more after allowing for the vertices' radius.

    Also the queries that are left to a block product, and how the audit went: missed (vertices that it missed at
    last) of truth (those that it should have found), and the widest beam.
    """
    n = len(graph.x)
    bar = float(np.cos(min(np.pi, np.arccos(min(least, 1.0)) + graph.radius.max(initial=0)))) - 1e-4
    q, audited = q.astype(np.float32), np.arange(min(AUDITED, len(q)))
    truth = q[audited] @ graph.x.T >= bar + 2e-4
    most = max(BEAM, n // DENSE)
    pairs, todo, width, dense = np.zeros(0, np.int64), np.arange(len(q)), BEAM, np.zeros(len(q), bool)
    before = np.full(len(q), -1)
    while True:
        found = [pairs]
        for low in range(0, len(todo), TOGETHER):
            part = todo[low : low + TOGETHER]
            ids, near = graph.search(q[part], width)
            hit = near >= bar
            a, b = np.nonzero(hit)[0], ids[hit].astype(np.int64)
            longer = hit[:, -1][a]
            more = walked(graph.x, graph.layers[0], q[part], a[longer], b[longer], bar, most) if longer.any() else (a[:0], b[:0])
            found.append(np.r_[part[a] * n + b, part[more[0]] * n + more[1]])
        pairs = np.unique(np.concatenate(found))
        count = np.bincount(pairs // n, minlength=len(q))
        dense |= count >= most
        got = np.zeros(truth.shape, bool)
        head = pairs[: np.searchsorted(pairs, len(audited) * n)]
        got[head // n, head % n] = True
        missed = truth & ~got & ~dense[audited][:, None]
        todo = np.union1d(todo[count[todo] > before[todo]], np.flatnonzero(missed.any(1)))
        todo, before = todo[~dense[todo]], count
        if not missed.any() or width >= n:
            break
        width = min(2 * width, n)
    if missed.any():  # no beam reaches them
        dense[:] = True
    pairs = pairs[~dense[pairs // n]]
    return pairs // n, pairs % n, np.flatnonzero(dense), {"missed": int(missed.sum()), "truth": int(truth.sum()), "width": width}


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component, by rounds of least neighbours and pointer jumps."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def counted(graph: Graph, xs: np.ndarray, rs: np.ndarray, copies: np.ndarray, xq: np.ndarray, rq: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's weight of links in the shard, and the star edges (u, v) of the components that they form.

    xs, rs, copies: vectors, ids and weights of the shard; xq, rq: vectors and ids of the queries. They ask SLICE at a time, so that
    no more than a slice's answers are held.
    """
    shard = _Shard(graph, scaled(xs), rs, copies, least)
    total, edges = np.zeros(len(rq), np.int64), [(rs[:0], rs[:0])]
    for low in range(0, len(rq), SLICE):
        total[low : low + SLICE], *star = shard.asked(scaled(xq[low : low + SLICE]), rq[low : low + SLICE])
        edges.append(tuple(star))
    u, v = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    root = stars(len(names), at[: len(u)], at[len(u) :])
    out = root != np.arange(len(names))
    return total, names[out], names[root[out]]


class _Shard:
    def __init__(self, graph: Graph, xs: np.ndarray, rs: np.ndarray, copies: np.ndarray, least: float):
        self.graph, self.xs, self.rs, self.copies, self.least = graph, xs, rs, copies, least
        self.us, self.theta, self.ns = unit(xs), float(np.arccos(min(least, 1.0))), np.sqrt(products(xs, xs))
        self.of_vertex = np.bincount(graph.owner, copies, len(graph.x)).astype(np.int64)
        self.order = np.argsort(rs)

    def asked(self, xq: np.ndarray, rq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weight of each query's links, and star edges (u, v)."""
        graph, xs, rs, copies, ns, us, theta = self.graph, self.xs, self.rs, self.copies, self.ns, self.us, self.theta
        uq, nq = unit(xq), np.sqrt(products(xq, xq))
        a, l, dense, _ = reached(graph, uq, self.least)
        total, edges = np.zeros(len(rq), np.int64), []
        place = self.order[np.minimum(np.searchsorted(rs, rq, sorter=self.order), len(rs) - 1)]
        own = np.where(rs[place] == rq, place, -1)  # where the query itself is in the shard
        whole = np.zeros(len(graph.x), bool)
        for low in range(0, len(a), STRIP):
            i, k = a[low : low + STRIP], l[low : low + STRIP]
            angle = angles(uq[i], graph.exact[k])
            sure = (angle + graph.radius[k] <= theta - 1e-6) & (graph.radius[k] > 0)
            np.add.at(total, i[sure], self.of_vertex[k[sure]])
            inside = sure & (own[i] >= 0) & (graph.owner[own[i]] == k)
            np.subtract.at(total, i[inside], copies[own[i[inside]]])
            edges.append((i[sure], len(rq) + graph.vertices[k[sure]]))
            whole[k[sure]] = True
            i, k = i[~sure & (angle <= theta + graph.radius[k] + 1e-6)], k[~sure & (angle <= theta + graph.radius[k] + 1e-6)]
            many = np.cumsum(graph.start[k + 1] - graph.start[k])
            done = 0
            while done < len(k):  # members of the other vertices, some at a time
                high = max(done + 1, int(np.searchsorted(many, (many[done - 1] if done else 0) + STRIP)))
                n = graph.start[k[done:high] + 1] - graph.start[k[done:high]]
                first = np.repeat(graph.start[k[done:high]] - np.r_[0, np.cumsum(n)[:-1]], n)
                j, q = graph.members[first + np.arange(n.sum())], np.repeat(i[done:high], n)
                linked = (products(xq[q], xs[j]) / (nq[q] * ns[j]) >= self.least) & (rq[q] != rs[j])
                np.add.at(total, q[linked], copies[j[linked]])
                edges.append((q[linked], len(rq) + j[linked]))
                done = high
        for low in range(0, len(dense), TOGETHER // 2):
            part = dense[low : low + TOGETHER // 2]
            cosine = uq[part] @ us.T
            i, j = np.nonzero(np.abs(cosine - self.least) < 1e-9)
            cosine[i, j] = products(xq[part[i]], xs[j]) / (nq[part[i]] * ns[j])
            linked = (cosine >= self.least) & (rq[part][:, None] != rs)
            total[part] = linked @ copies
            i, j = np.nonzero(linked)
            root = stars(len(part) + len(rs), i, len(part) + j)
            names = np.r_[part, len(rq) + np.arange(len(rs))]
            edges.append((names, names[root]))
        shown = np.flatnonzero(whole[graph.owner])
        edges.append((len(rq) + shown, len(rq) + graph.vertices[graph.owner[shown]]))
        names = np.r_[rq, rs]
        root = stars(len(names), *(np.concatenate([e[k] for e in edges]) for k in (0, 1)))
        star = np.stack([names, names[root]], 1)
        star = np.unique(star[star[:, 0] != star[:, 1]], axis=0)
        return total, star[:, 0], star[:, 1]


KEYS = ["label", "dim", "part"]
PACKED = "label long, dim int, part int, reps binary, copies binary, vectors binary, graph binary"


def packed(classes: DataFrame, parts: str, kind: str, least: float | None) -> DataFrame:
    """One row for each label, length and part (some thousand classes, ordered by hash): ids, weights, vectors, and with `least` the graph."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
        open_key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            rep, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            flat, offset = np.asarray(batch.column(5).flatten()), np.asarray(batch.column(5).offsets)
            offset = offset - offset[0]
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for low, high in zip(first, [*first[1:], len(keys)], strict=True):
                if held and open_key != tuple(keys[low]):
                    yield open_key, *(np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                open_key = tuple(keys[low])
                held.append((rep[low:high], copies[low:high], flat[offset[low] : offset[high]].reshape(high - low, -1)))
        if held:
            yield open_key, *(np.concatenate(c) for c in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rep, copies, x in groups(batches):
            graph = Graph.build(unit(x.astype(np.float64)), least).packed() if least is not None else b""
            binary = (rep.astype("<i8").tobytes(), copies.astype("<i8").tobytes(), x.astype(kind).tobytes(), graph)
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)), *(pa.array([v], pa.binary()) for v in binary)], [*KEYS, "reps", "copies", "vectors", "graph"])

    part = F.pmod(F.xxhash64("embedding"), F.col(parts)).cast("int").alias("part")
    rows = classes.select("label", "dim", part, "rep", "copies", "embedding", F.xxhash64("embedding", F.lit(5)).alias("order"))
    ordered = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "order", "rep").drop("order")
    return ordered.mapInArrow(run, PACKED)


FOUND = "rep long, label long, weight long, u long, v long"


def compared(shards: DataFrame, chunks: DataFrame, tasks: int, kind: str, least: float) -> DataFrame:
    """For each shard and chunk of its label: (rep, label, weight of its links there, null, null), and (null, null, null, u, v) of a star forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, reps, copies, vectors, graph, q_reps, q_vectors in zip(*(batch.column(k) for k in range(7)), strict=True):
                if not q_reps.is_valid:
                    q_reps, q_vectors = reps, vectors
                rs, w, rq = (np.frombuffer(c.as_buffer(), "<i8") for c in (reps, copies, q_reps))
                xs, xq = (np.frombuffer(c.as_buffer(), kind).reshape(len(r), -1).astype(np.float64) for c, r in ((vectors, rs), (q_vectors, rq)))
                total, u, v = counted(Graph.unpacked(unit(xs), graph.as_py()), xs, rs, w, xq, rq, least)
                who = np.flatnonzero(total)
                no, none = pa.nulls(len(who), pa.int64()), pa.nulls(len(u), pa.int64())
                label = pa.array(np.full(len(who), label.as_py()), pa.int64())
                left, right = [pa.array(rq[who]), label, pa.array(total[who]), no, no], [none, none, none, pa.array(u), pa.array(v)]
                for columns in (left, right):
                    yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "weight", "u", "v"])

    asked = chunks.select("label", "dim", F.col("part").alias("q_part"), F.col("reps").alias("q_reps"), F.col("vectors").alias("q_vectors"))
    # A label without chunks is one shard and one chunk: its own vectors ask. Pairs are dealt in turn, so evenly by number.
    pairs = shards.join(asked, ["label", "dim"], "left").repartition(tasks)
    return pairs.select("label", "reps", "copies", "vectors", "graph", "q_reps", "q_vectors").mapInArrow(run, FOUND)


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    ship(vectors.sparkSession)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    sound = usable(vectors, "label").where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("long"))
    classes = written(sound.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    parts = lambda size, numbers: F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.lit(size), (numbers / F.col("dim")).cast("int")))).cast("int")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), parts(shard, F.lit(SHARD_NUMBERS)).alias("shards"), parts(chunk, F.lit(CHUNK_NUMBERS)).alias("chunks"))
    pairs, searches = sizes.agg(F.sum(F.col("shards").cast("long") * F.col("chunks")), F.sum(F.col("shards") * F.col("n"))).first()
    tasks = max(1, min(pairs or 0, (searches or 0) // 1024 + 1))
    placed = classes.join(sizes, ["label", "dim"])
    graphs = written(packed(placed, "shards", kind, least), "graphs")
    found = written(compared(graphs, packed(placed.where("shards > 1 or chunks > 1"), "chunks", kind, None), tasks, kind, least), "vector-links")
    linked = found.where("rep is not null").groupBy("rep", "label").agg(F.sum("weight").alias("others"))
    whole = components(found.where("u is not null").select("u", "v"))
    about = classes.join(linked, ["rep", "label"], "left").join(whole.withColumnRenamed("vertex", "rep"), "rep", "left")
    about = about.select(F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    # A label and vector that take no part meet no class.
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long").alias("label"))
    joined = rows.join(about, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
