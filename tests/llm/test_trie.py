import hashlib
import random
import sys
import zlib

from recordwell.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string, code long, depth long, rep long, n int"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """Straight from the definition, over tuples."""
    sys.setrecursionlimit(20_000)
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):  # leaves and saving of its subtree
        leaves, saved = 0, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for k in kids.get(p, []):
            a, b = walk(k)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if full[c] == p))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, ends))
        return leaves, saved

    if members:
        walk(())
    return sorted(out, key=repr)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], CONV)
    assert sorted(map(tuple, prefix_trie.trie(frame).collect()), key=repr) == brute(rows)


def conversations(n, seed, words=3, most=7, first=0):
    r = random.Random(seed)
    return [(first + c, t, r.choice(["user", "assistant", None]), r.choice(["", "a", "b", "ä ö", None][:words + 1])) for c in range(n) for t in range(r.randint(1, most))]


def test_equals_brute_force(spark):
    check(spark, conversations(60, 1))


def test_large_buckets_are_split_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LOCAL", 12)
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    copies = [(5 * c, t, "user", f"turn {t}") for c in range(40) for t in range(12)]  # one text, many conversations that end together
    more = [(5 * c, t, "user", f"turn {t}" if t < 6 else f"{c % 3} {t}") for c in range(40, 60) for t in range(9)]
    check(spark, copies + more + conversations(30, 2, first=1000))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, "user", "first"), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "y"), (-3, 1, None, None), (-3, 0, "", ""), (0, 5, "user", "long " * 20_000), (8, 2, "a", "b"), (8, 2, "ab", "")]
    rows += [(11, t, "user", f"{t}") for t in range(1500)]  # most rows are one conversation
    check(spark, rows)
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2, 3, 4)], CONV)).count() == 0


def test_running_sums_over_ranges(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # else so few rows are one range
    try:
        assert_running(spark)
        check(spark, [(c, t, "user", f"{t}") for c in (3, 4, 9) for t in range(200)])
    finally:
        spark.conf.unset(setting)


def assert_running(spark):
    rows = [(g, k, (k * 7) % 5) for g in (1, 2, 3) for k in range(1 if g == 2 else 400)]
    got = prefix_trie.running(spark.createDataFrame(rows, "g int, k int, v long").repartition(7), ["g"], ["k"], "v", "running")
    want, total = {}, {}
    for g, k, v in sorted(rows):
        want[g, k] = total.get(g, 0)
        total[g] = want[g, k] + v
    assert {(r.g, r.k): r.before for r in got.collect()} == want
