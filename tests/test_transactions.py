import random

from recordwell.operators import transactions

OPS, NOW = "txn string, place long, k long, read string", "k long, version string"


def plain(operations, present):
    """One transaction after the other."""
    versions, touched, out = dict(present), set(), {}
    by = {}
    for txn, place, k, read in operations:
        by.setdefault((place, txn), set()).add((k, read))
    for (_, txn), ops in sorted(by.items()):
        if any(k is None or versions.get(k) != read for k, read in ops):
            out[txn] = "stale"
        elif {k for k, _ in ops} & touched:
            out[txn] = "conflict"
        else:
            out[txn] = "accepted"
            touched |= {k for k, _ in ops}
    return out


def test_two_plans_over_one_record(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, name string")
    operations = spark.createDataFrame([("t1", 1, 1), ("t1", 1, 2), ("t2", 2, 2), ("t2", 2, 3), ("t3", 3, 3), ("t4", 4, 9), ("t4", 4, 9)], "txn string, place long, k long")
    read = transactions.planned(operations, records, "k", ["name"])
    now = transactions.versions(records, "k", ["name"])
    got = transactions.decided(read, now, "k")
    # t2 meets t1's record 2, so it is refused with its record 3, too, which leaves that to t3.
    assert {r.txn: r.verdict for r in got.collect()} == {"t1": "accepted", "t2": "conflict", "t3": "accepted", "t4": "accepted"}
    assert sorted(r.txn for r in transactions.accepted(read, got).collect()) == ["t1", "t1", "t3", "t4", "t4"]
    gone = transactions.versions(records.where("k <> 2"), "k", ["name"])
    assert {r.txn: r.n_stale for r in transactions.stale(read, gone, "k").collect()} == {"t1": 1, "t2": 1}
    assert transactions.decided(read.limit(0), now, "k").count() == 0


def test_equals_one_after_the_other(spark):
    r = random.Random(5)
    present = [(k, f"v{k}") for k in range(40)]
    operations = [(f"t{t}", t // 2, k, f"v{k}" if r.random() < 0.95 else r.choice(["old", None])) for t in range(120) for k in r.sample(range(45), r.randint(1, 3))]
    operations += [("null", 500, None, None)]
    got = transactions.decided(spark.createDataFrame(operations, OPS), spark.createDataFrame(present, NOW), "k")
    assert {x.txn: x.verdict for x in got.collect()} == plain(operations, present)
