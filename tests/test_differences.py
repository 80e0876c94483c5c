import json

from recordwell.operators.differences import difference_maps, differences


def test_nested_lists_numbers_and_odd_rows(spark):
    cases = [
        ({"a": {"b": [1, {"c": "x"}]}}, {"a": {"b": [1, {"c": "y"}]}}, {".a.b[1].c": ("changed", '"x"', '"y"')}),
        ("[1,2,3]", "[3,1,2]", {"[0]": ("moved", "[2]", "[0]"), "[1]": ("moved", "[0]", "[1]"), "[2]": ("moved", "[1]", "[2]")}),
        ("[1,1,2]", "[1,2]", {"[1]": ("moved", "[2]", "[1]"), "[was 1]": ("removed", "1", None)}),
        ('{"n":1.50,"z":0,"b":10e2,"t":"1"}', '{"n":15e-1,"z":0.00,"b":1000,"t":1}', {".t": ("changed", '"1"', "1")}),
        ('{"x":null}', "{}", {".x": ("removed", "null", None)}),
        ("{}", '{"x":[],"y":{}}', {".x": ("added", None, "[]"), ".y": ("added", None, "{}")}),
        ('{"x":[]}', '{"x":{}}', {".x": ("changed", "[]", "{}")}),
        (None, "7", {"": ("added", None, "7")}),
        ("7", None, {"": ("removed", "7", None)}),
        (None, None, {}),
        ("no json {", "no json }", {"": ("changed", '"no json {"', '"no json }"')}),
        ("", "", {}),
        ('{"p.q":{"r":true}}', '{"p.q":{"r":false}}', {".p.q.r": ("changed", "true", "false")}),
    ]
    text = lambda x: json.dumps(x) if isinstance(x, dict) else x
    df = spark.createDataFrame([(k, text(a), text(b)) for k, (a, b, _) in enumerate(cases)], "id long, o string, n string")
    found = differences(df, "id", "o", "n")
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.path] = (r.op, r.old, r.new)
    want = {k: w for k, (_, _, w) in enumerate(cases) if w}
    assert got == want
    maps = {r.id: r["diff"] for r in difference_maps(found, "id").collect()}
    assert maps[0][".a.b[1].c"].new == '"y"' and set(maps[1]) == {"[0]", "[1]", "[2]"}
    assert differences(df.limit(0), "id", "o", "n").count() == 0


def test_equal_parts_go_no_further(spark, monkeypatch):
    from recordwell.operators import differences as module

    sizes = {}
    was = module.kept
    monkeypatch.setattr(module, "kept", lambda df, label: [sizes.update({label: (got := was(df, label)).count()}), got][1])
    df = spark.createDataFrame([(1, '{"a":[1,2],"b":"x","c":1.0,"w":"Infinity"}', '{"w":"Infinity","c":10e-1,"b":"y","a":[1,2]}'), (2, '{"a":1}', '{ "a": 1 }'), (3, "1e400", '"Infinity"')], "id long, o string, n string")
    found = {(r.id, r.path, r.op) for r in differences(df, "id", "o", "n").collect()}
    assert {x for x in found if x[0] < 3} == {(1, ".b", "changed")}
    assert sizes["pairs"] <= 2 and sizes["next-0"] <= 2  # of the names of the first row, those with other JSON
