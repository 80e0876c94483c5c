"""Delimited tables read by splits equal the csv module's reading of the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from recordwell.sources.delimited import TableError, read_table


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def plain(text, sep):
    """(line, cells) of the rows behind the header, as the csv module sees the whole text."""
    reader, out, start = csv.reader(io.StringIO(text, newline=""), delimiter=sep), [], 1
    for cells in reader:
        line, start = start, reader.line_num + 1
        if any(c.strip() for c in cells):
            out.append((line, cells))
    return out[0][1], out[1:]


def check(spark, path, text, sep, data=None):
    path.write_bytes(data if data is not None else text.encode())
    header, rows = plain(text, sep)
    got = read_table(spark, str(path), delimiter=sep).orderBy("row_no").collect()
    assert [(r.row_no, list(r)[: len(header)]) for r in got] == [(n, (c + [""] * len(header))[: len(header)]) for n, c in rows]
    assert [r.broken for r in got] == [any(x.strip() for x in c[len(header) :]) for _, c in rows]


@pytest.mark.parametrize("seed", range(4))
def test_random_tables_by_many_splits(spark, small_splits, tmp_path, seed):
    r = random.Random(seed)
    sep, end = r.choice([";", ",", "\t"]), r.choice(["\n", "\r\n"])

    def cell():
        text = "".join(r.choice(["a", "é", " ", '""' if r.random() < 0.7 else "", sep, end, "long words here "]) for _ in range(r.choice([0, 1, 2, 5, 30])))
        if r.random() < 0.15:
            return 'a"b' + r.choice(["", '"'])  # a quote within a cell that has none at its start
        return f'"{text}"' + r.choice(["", "", "tail"]) if r.random() < 0.6 else text.replace(sep, "").replace(end, "").replace('"', "")

    lines = [sep.join(["Name", "Betrag", '"Bemer""kung"'])]
    lines += [sep.join(cell() for _ in range(r.choice([3, 3, 3, 2, 1, 4, 5]))) for _ in range(60)]
    check(spark, tmp_path / "t.csv", end.join(lines) + (end if seed % 2 else ""), sep)


def test_encodings_marks_and_lines_before_the_header(spark, small_splits, tmp_path):
    text = 'Größe;Ort\n1;"München\n€"\n2;x\n' + "".join(f"{k};plain\n" for k in range(30))
    check(spark, tmp_path / "a.csv", text, ";", text.encode("utf-16"))
    check(spark, tmp_path / "b.csv", text, ";", text.encode("cp1252"))
    check(spark, tmp_path / "c.csv", text, ";", text.encode("utf-8-sig"))
    (tmp_path / "e.csv").write_text("sep=|\r\na|b\r\n1|2\r\n||\r\n3|4|5\r\n", newline="")
    assert [(r.row_no, r.a, r.b, r.problem) for r in read_table(spark, str(tmp_path / "e.csv")).orderBy("row_no").collect()] == [(3, "1", "2", None), (5, "3", "4", "extra-cells")]


def test_refused_files(spark, small_splits, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n ; \n")
    (tmp_path / "open.csv").write_text('a;b\n1;2\n3;"never\n' + "x;y\n" * 100)
    for name in ("empty", "blank"):
        with pytest.raises(TableError, match="header"):
            read_table(spark, str(tmp_path / f"{name}.csv"))
    with pytest.raises(TableError, match="line 3"):
        read_table(spark, str(tmp_path / "open.csv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("a;b\n1;2\n")
    (tmp_path / "two" / "b.csv").write_text('a;b\n"3\n4";5\n')
    assert sorted((r.a, r.row_no) for r in read_table(spark, str(tmp_path / "two")).collect()) == [("1", 2), ("3\n4", 2)]
    (tmp_path / "two" / "c.csv").write_text("other;b\n1;2\n")
    with pytest.raises(Exception, match="another header"):
        read_table(spark, str(tmp_path / "two")).collect()


def test_a_record_over_many_splits(spark, small_splits, tmp_path):
    long = "\n".join(f"line {k}; with \"\"quotes\"\"" for k in range(300))
    check(spark, tmp_path / "l.csv", f'a;b\n1;"{long}"\n2;z\n', ";")
    assert read_table(spark, str(tmp_path / "l.csv")).where("a = '1'").select(F.length("b").alias("n")).first().n == len(long.replace('""', '"'))
