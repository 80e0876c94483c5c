"""The change log by lines: numbers across splits, cursors, faults."""

import json
import random

import pytest

from recordwell.sources import change_log as L


def event(k, **more):
    return json.dumps({"event_id": f"e{k}", "at": "2026-01-05T10:00:00Z", "op": "update", "object": "deal", "record_id": f"r{k % 7}", "changes": {"stage": ["A", f"B{k}"]}, **more})


@pytest.fixture
def small_splits(spark):
    limits = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def wanted(folder, done=None):
    out = set()
    for f in folder.glob("*.jsonl"):
        for n, line in enumerate(f.read_text().split("\n"), 1):
            if line.strip() and n > (done or {}).get(f.name, 0):
                out.add((f.name, n, json.loads(line)["event_id"]))
    return out


def places(df):
    return {(r.shard, r.seq, r.event_id) for r in df.collect()}


def cursor_of(df):
    return {r.shard: r.line for r in df.collect()}


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    rng, k = random.Random(1), 0
    for month in range(1, 5):
        lines = []
        for _ in range(200 * month):
            lines.append(rng.choice(["", "  "]) if rng.random() < 0.1 else event(k, actor="ü" * rng.randrange(60)))
            k += 1
        (tmp_path / f"2026-0{month}.jsonl").write_text("\n".join(lines) + "\n" * (month % 2))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = L.read_events(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == len(wanted(tmp_path)) and places(got) == wanted(tmp_path)
    assert all(r.changes["stage"].new == "B" + r.event_id[1:] and r.problem is None for r in rows)
    done = {"2026-02.jsonl": 399, "2026-03.jsonl": 17, "2026-09.jsonl": 5}
    cursor = spark.createDataFrame(list(done.items()), L.CURSOR)
    assert places(L.read_events(spark, str(tmp_path), cursor.union(cursor))) == wanted(tmp_path, done)
    end = cursor_of(L.log_end(spark, str(tmp_path)))
    assert end == {f.name: len(f.read_text().removesuffix("\n").split("\n")) for f in tmp_path.glob("*.jsonl")}


def test_every_event_once_over_plans_of_a_growing_log(spark, tmp_path):
    (tmp_path / "2026-01.jsonl").write_text("\n".join(event(k) for k in range(10)) + "\n\n")
    cursor, seen = spark.createDataFrame([], L.CURSOR), []
    for step in range(12):
        if step in (2, 4):  # lines are appended to a shard that was read to its end, or in part, and a new shard begins
            with open(tmp_path / "2026-01.jsonl", "a") as f:
                f.write(event(100 + step) + "\n")
            (tmp_path / f"2026-0{step}.jsonl").write_text(event(200 + step) + "\n" + event(300 + step) + "\n")
        now, stop = L.due(L.read_events(spark, str(tmp_path), cursor), 4)
        seen += [r.event_id for r in now.collect()]
        state = cursor_of(L.moved(cursor, L.log_end(spark, str(tmp_path)), stop))
        cursor = spark.createDataFrame(list(state.items()), L.CURSOR)
    assert sorted(seen) == sorted(e for _, _, e in wanted(tmp_path)) and len(seen) == 16
    assert state == {"2026-01.jsonl": 13, "2026-02.jsonl": 2, "2026-04.jsonl": 2}


def test_faults(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert L.read_events(spark, str(tmp_path / "a")).count() == 0
    (tmp_path / "a" / "2026-01.jsonl").write_text(event(1) + "\n\n" + '{"event_id": "x", "at": "never"}\n3\n[]\n' + event(1) + "\n")
    rows = L.read_events(spark, str(tmp_path / "a")).orderBy("seq").collect()
    assert [(r.seq, r.problem) for r in rows] == [(1, None), (3, "invalid-event"), (4, "invalid-event"), (5, "invalid-event"), (6, None)]
    with open(tmp_path / "a" / "2026-01.jsonl", "a") as f:
        f.write('{"event_id": "y", \n')
    with pytest.raises(Exception, match=r"2026-01.jsonl:7: invalid JSON"):
        L.read_events(spark, str(tmp_path / "a")).count()
