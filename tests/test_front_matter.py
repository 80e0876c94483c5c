"""Typed front matter: kinds of values, problems, round trips."""

import json

import pytest
from pyspark.sql import functions as F

from recordwell.operators import front_matter as M

PAGE = """---
# first
title: A page: of things
quoted: "say \\"x\\", ü\\n"
single: 'it''s'
n: 12
minus: -7
ratio: 1.50
zero: 007
yes: True
no: false
nothing: ~
tags: [a, "b, c", 'd''e', 3, null]
none: []
empty:
notes:
  - one
  # between
  - 2

  - "3"
  - it's, so
url: https://x.org/a#b
---
# Body

---
"""


def read(spark, *texts):
    rows = M.typed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")).select("k", F.to_json("data").alias("data"), "comments", "body", "problems")
    return [(json.loads(r.data) if r.data is not None else None, r.comments, r.body, r.problems) for r in rows.orderBy("k").collect()]


def test_values(spark):
    for text in (PAGE, PAGE.replace("\n", "\r\n")):
        data, comments, body, problems = read(spark, text)[0]
        assert problems == [] and comments == ["# first", "# between"] and body.replace("\r", "") == "# Body\n\n---\n"
        assert data == {
            "title": "A page: of things", "quoted": 'say "x", ü\n', "single": "it's", "n": 12, "minus": -7, "ratio": 1.5, "zero": "007", "yes": True, "no": False, "nothing": None,
            "tags": ["a", "b, c", "d'e", 3, None], "none": [], "empty": [], "notes": ["one", 2, "3", "it's, so"], "url": "https://x.org/a#b",
        }
        assert list(data)[:3] == ["title", "quoted", "single"]


def test_problems(spark):
    heads = {
        "a: 1\n\tb: 2": (["tabs: \tb: 2"], {"a": 1}), "  - x\na: 1": (["indent:   - x"], {"a": 1}), "a: 1\n  - x": (["item: a"], {}), "a:\n    - x": (["indent:     - x"], {"a": []}), "just text": (["key: just text"], {}),
        "a b : 1": (["key: a b : 1"], {}), "__proto__: 1": (["key: __proto__: 1"], {}), "a: 1\nb: 2\na: 3": (["duplicate: a"], {"a": 1, "b": 2}), 'a: "x': (["quote: a"], {}), 'a: "x\\q"': (["quote: a"], {}), "a: 'x": (["quote: a"], {}),
        "a: [x, , y]": (["list: a"], {}), "a: [x": (["list: a"], {}), "a: [[x]]": (["list: a"], {}), "a: {b: 1}": (["nested: a"], {}), "a: |": (["block: a"], {}), "a: 1.0e999": (["number: a"], {}), "a:\n  - {x}": (["nested: a"], {}),
    }
    got = read(spark, *(f"---\n{h}\n---\nbody" for h in heads))
    assert [(g[3], g[0], g[2]) for g in got] == [(*want, "body") for want in heads.values()]
    rest = read(spark, None, "", "no head", "---\na: 1\n", "---\n---\nx", "---\r\n---", "---\n# c\n---\n" + "long " * 300_000)
    assert [r[3] for r in rest[1:]] == [[], [], ["unclosed"], [], [], []] and rest[0][0] is None and all(r[0] == {} for r in rest[1:])
    assert rest[3][2] == "---\na: 1\n" and rest[4][2] == "x" and rest[6][1] == ["# c"] and len(rest[6][2]) == 1_500_000


def test_long_heads(spark):
    many = "\n".join(f"k{n}: {n}" for n in range(3000)) + "\nlist: [" + ", ".join(f"'v{n}'" for n in range(20_000)) + "]\nitems:\n" + "\n".join(f"  - {n}" for n in range(20_000))
    data, _, _, problems = read(spark, f"---\n{many}\n---\n")[0]
    assert problems == [] and len(data) == 3002 and data["k2999"] == 2999 and len(data["list"]) == len(data["items"]) == 20_000


def test_types_are_kept_through_edit_and_write(spark):
    odd = ["true", "12", "1.5", " x", "x ", "", "~", "#x", "- x", "a: b", "[x]", "x]", "{", '"', "'", "null", "two\nlines", "tab\t", "|", "ü", "日本", "a\\b"]
    page = "---\n" + "".join(f"s{k}: {json.dumps(v)}\n" for k, v in enumerate(odd)) + "list:\n" + "".join(f"  - {json.dumps(v)}\n" for v in odd) + PAGE[4:]
    first = M.typed(spark.createDataFrame([(page,)], "text string"))
    wrote = first.select("data", F.concat(M.head_text(M.put(M.put(M.put(F.col("data"), "n", F.lit("12").cast("variant")), "more", F.lit(2.5).cast("variant")), "yes", None), F.col("comments")), "body").alias("text"))
    (was, _, body, p1), (data, comments, same, p2) = read(spark, page)[0], read(spark, wrote.first().text)[0]
    assert p1 == p2 == [] and same == body and comments == ["# first", "# between"]
    assert [was[f"s{k}"] for k in range(len(odd))] == odd == was["list"] == data["list"]
    assert data == {**{k: v for k, v in was.items() if k != "yes"}, "n": "12", "more": 2.5} and list(data) == [k for k in was if k != "yes"] + ["more"]


def test_clashing_and_dotted_columns(spark):
    df = spark.createDataFrame([("---\na: 1\n---\nx", 1, 2)], "text string, `a.b` long, body long")
    r = M.typed(df).select("`a.b`", "body", "text").first()
    assert tuple(r) == (1, "x", "---\na: 1\n---\nx")
    assert M.typed(df.limit(0)).count() == 0


