"""Known answers for filters, aggregates, stages and displays."""

import datetime as dt
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordwell.context import Context, add_months, period
from recordwell.functions.values import display, value
from recordwell.deploy import ensure_checkpoint
from recordwell.operators import aggregates, changes, relations, timeline
from recordwell.operators.filters import FilterError, condition, implied, matching, problems, relative_range
from recordwell.operators.sorting import SortError, page, sort_columns
from recordwell.operators.step_filters import first_branch, leaf_condition, step_condition
from recordwell.schema import Model, SchemaError

NOW = Context.at("2026-08-25T08:00:00+00:00", "Europe/Berlin", me="m1")
DEAL = Model.from_document(
    {
        "objects": {
            "deal": {
                "labelField": "name",
                "label": "Deal",
                "fields": {
                    "name": {"type": "TEXT"}, "amount": {"type": "CURRENCY"}, "close": {"type": "DATE_TIME"}, "day": {"type": "DATE"}, "won": {"type": "BOOLEAN"}, "code": {"type": "NUMERIC"}, "tags": {"type": "MULTI_SELECT"}, "rating": {"type": "RATING"},
                    "stage": {"type": "SELECT", "options": [{"value": s, "label": s.title()} for s in ("NEW", "SCREENING", "MEETING", "PROPOSAL", "CUSTOMER")]}, "owner": {"type": "RELATION", "relation": {"target": "deal"}},
                },
            }
        }
    }
).object("deal")
ROWS = [
    ("1", "Relaunch", (12500500000, "EUR"), "2026-09-30 10:00:00", dt.date(2026, 8, 25), True, "10", ["A", "b"], "RATING_5", "PROPOSAL", ("deal", "m1", "Max Müller")),
    ("2", "Wartung", (3000000000, "EUR"), "2026-10-15 10:00:00", dt.date(2026, 8, 24), False, "10.0", ["b"], "RATING_1", "MEETING", None),
    ("3", "Lizenz STRASSE", (1000000000, "USD"), None, None, None, "9", [], None, "PROPOSAL", ("deal", "m2", "anna")),
    ("4", "straße", (200000000, "EUR"), "2026-08-24 22:30:00", dt.date(2026, 9, 1), True, "", None, "RATING_3", "SCREENING", None),
    ("5", None, None, "2026-08-25 21:59:00", None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def deals(spark):
    link = "struct<object:string,id:string,title:string>"
    df = spark.createDataFrame(ROWS, f"crm_id string, name string, amount struct<amountMicros:long,currencyCode:string>, close string, day date, won boolean, code string, tags array<string>, rating string, stage string, owner {link}")
    return df.withColumns({"close": F.col("close").cast("timestamp"), "crm_deleted_at": F.lit(None).cast("timestamp"), "crm_title": F.col("name")})


def ids(df, spec):
    return "".join(sorted(r.crm_id for r in df.where(condition(DEAL, spec, NOW)).collect()))


def leaf(field, operand, value=None):
    return {"field": field, "operand": operand, "value": value}


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (None, "12345"), ([], "12345"), ({"op": "OR", "conditions": []}, "12345"), ({"op": "NOT", "conditions": []}, ""),
        (leaf("stage", "IS_NOT", "proposal"), "245"), (leaf("stage", "IS", ["NEW", "meeting"]), "2"), (leaf("close", "IS_NOT", "2026-09-30"), "245"), ({"op": "NOT", "conditions": [leaf("close", "IS_BEFORE", "2026-10-01")]}, "23"),
        (leaf("name", "CONTAINS", "strasse"), "34"), (leaf("name", "CONTAINS", ""), "12345"), (leaf("name", "DOES_NOT_CONTAIN", "W"), "1345"), (leaf("tags", "CONTAINS", ["a"]), "1"), (leaf("tags", "IS", "B"), "12"), (leaf("tags", "IS_NOT", "B"), "345"),
        (leaf("amount", "greaterThan", "3000"), "12"), (leaf("amount", "LESS_THAN_OR_EQUAL", 1000), "34"), (leaf("amount", "IS", 200), "4"), (leaf("amount", "GREATER_THAN_OR_EQUAL", "much"), ""), (leaf("amount.currencyCode", "IS", "eur"), "124"),
        (leaf("code", "IS", "10"), "1"), (leaf("code", "IS", 10), "12"), (leaf("rating", "GREATER_THAN_OR_EQUAL", 3), "14"), (leaf("rating", "IS", 5), "1"), (leaf("won", "IS", "true"), "14"), (leaf("won", "IS_NOT", True), "235"),
        (leaf("close", "IS_TODAY"), "45"), (leaf("day", "IS_TODAY"), "1"), (leaf("close", "IS_IN_PAST"), "4"), (leaf("close", "IS_IN_FUTURE"), "125"), (leaf("day", "IS_IN_FUTURE"), "4"), (leaf("close", "IS_RELATIVE", "NEXT_2_MONTHS"), "12"), (leaf("day", "IS_RELATIVE", "PAST_1_DAY"), "2"),
        (leaf("owner", "IS", "@me"), "1"), (leaf("owner", "IS", "[[records/deal/m2|x]]"), "3"), (leaf("owner", "CONTAINS", "mül"), "1"), (leaf("owner", "IS_EMPTY"), "245"), (leaf("code", "isEmpty"), "45"), (leaf("tags", "IS_NOT_EMPTY"), "12"), (leaf("stage", "IS", None), "5"),
        (leaf("close", "IS", "2026-08-24T23:30:00Z"), "45"), (leaf("close", "IS", "never"), ""),
    ],
)
def test_filters(deals, spec, want):
    assert ids(deals, spec) == want


def test_implied_comparisons_reach_the_scan(deals, spark, tmp_path):
    deals.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    for spec in ([leaf("close", "IS_TODAY")], leaf("close", "IS_AFTER", "2026-09-01"), {"op": "AND", "conditions": [leaf("day", "IS_RELATIVE", "PAST_1_DAY")]}, leaf("close", "IS", "2026-08-24T23:30:00Z"), leaf("close", "IS_IN_PAST"), leaf("day", "LESS_THAN_OR_EQUAL", "2026-08-24")):
        got = matching(stored, DEAL, spec, NOW)
        assert "".join(sorted(r.crm_id for r in got.collect())) == ids(deals, spec)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan" in plan or "LessThan" in plan
    assert implied(DEAL, {"op": "OR", "conditions": [leaf("close", "IS_TODAY")]}, NOW) == [] and implied(DEAL, leaf("close", "IS_NOT", "2026-01-01"), NOW) == []


def test_filter_problems():
    found = problems(DEAL, [leaf("nope", "IS", 1), leaf("name", "IS_TODAY"), leaf("close", "IS_RELATIVE", "SOON"), leaf("stage", "IS", "GONE"), leaf("name", "ROUGHLY", 1)])
    assert len(found) == 5
    with pytest.raises(FilterError):
        condition(DEAL, {"op": "XOR", "conditions": [leaf("name", "IS", 1)]}, NOW)
    with pytest.raises(SchemaError):
        DEAL.resolve("amount.weight")


def test_relative_ranges():
    day = dt.date
    assert relative_range("PAST_1_MONTH", NOW) == (day(2026, 7, 25), day(2026, 8, 24))
    assert relative_range("NEXT_2_WEEKS", NOW) == (day(2026, 8, 26), day(2026, 9, 8))
    assert relative_range("THIS_9_QUARTER", NOW) == (day(2026, 7, 1), day(2026, 9, 30))
    assert period(day(2026, 8, 25), "WEEK", 7) == (day(2026, 8, 23), day(2026, 8, 29))
    assert add_months(day(2024, 1, 31), 1) == day(2024, 2, 29) and add_months(day(2026, 3, 31), -13) == day(2025, 2, 28)
    assert Context.at("2026-01-01T00:00:00Z", "Nowhere/Else").warnings and not NOW.warnings


def test_aggregates(deals):
    amount, stage, tags, won = (value(DEAL, k) for k in ("amount", "stage", "tags", "won"))
    col = aggregates.aggregate_column
    r = deals.agg(col("AVERAGE", amount).alias("a"), col("PERCENTAGE_EMPTY", stage).alias("b"), F.lit(None).alias("c"), col("countTrue", won).alias("d"), col("COUNT_FALSE", won).alias("e"), col("MAX", value(DEAL, "close")).alias("f"), col("MIN", value(DEAL, "rating")).alias("g")).first()
    assert aggregates.unique_values(deals.withColumn("g", F.lit(1)), DEAL, "tags", ["g"]).first().unique_values == 2
    assert r.a == Decimal("4175.125") and r.b == 20 and (r.d, r.e) == (2, 1) and r.f == dt.datetime(2026, 10, 15, 10) and r.g == 1
    none = deals.limit(0).agg(col("SUM", amount).alias("s"), col("AVG", amount).alias("a"), col("PERCENTAGE_EMPTY", stage).alias("p")).first()
    assert none.s == 0 and none.a is None and none.p is None
    money = {(r.currency): r.value for r in aggregates.by_currency(deals, DEAL, "SUM", "amount", "EUR").collect()}
    assert money == {"EUR": Decimal("15700.5"), "USD": Decimal(1000)}
    groups = [(r.group_key, r.value) for r in aggregates.ordered_groups(aggregates.grouped(deals, DEAL, "COUNT", None, "stage")).collect()]
    assert groups == [("NEW", 0), ("SCREENING", 1), ("MEETING", 1), ("PROPOSAL", 2), ("CUSTOMER", 0), ("", 1)]
    months = {r.group_key: r.value for r in aggregates.grouped(deals, DEAL, "COUNT", None, "close", "MONTH", NOW).collect()}
    assert months == {"2026-09": 1, "2026-10": 1, "2026-08": 2, "": 1}
    lists = {r.group_key: r.value for r in aggregates.grouped(deals, DEAL, "COUNT", None, "tags").collect()}
    assert lists == {"A": 1, "b": 2, "": 3}
    with pytest.raises(aggregates.AggregateError):
        col("MEDIAN", amount)
    want = aggregates.expected(deals, DEAL, "amount", "stage", {"SCREENING": ".25", "MEETING": "0.4", "PROPOSAL": ".6"}).groupBy("currency").agg(F.sum("expected").alias("e"))
    assert {r.currency: r.e for r in want.collect()} == {"EUR": Decimal("8750.3"), "USD": Decimal(600)}


def test_sorting(deals):
    order = lambda *s: "".join(r.crm_id for r in deals.orderBy(*sort_columns(DEAL, list(s))).collect())
    assert order({"field": "stage"}) == "42135" and order({"field": "stage", "direction": "desc"}) == "13245"
    assert order({"field": "owner"}) == "31245" and order({"field": "code"}) == "12345" and order({"field": "rating", "direction": "desc"}) == "14235"
    assert [r.crm_id for r in page(deals, DEAL, [{"field": "amount", "direction": "desc"}], 2, 1).collect()] == ["2", "3"]
    with pytest.raises(SortError):
        page(deals, DEAL, None, 2000)


def test_display(deals):
    r = deals.where("crm_id = '1'").select(*(display(DEAL, k, "DOTS_AND_COMMA").alias(k) for k in ("amount", "stage", "won", "rating", "owner", "tags", "code"))).first()
    assert tuple(r) == ("12.500,50 EUR", "Proposal", "✓", "★★★★★", "Max Müller", "A, b", "10")
    empty = deals.where("crm_id = '5'").select(*(display(DEAL, k).alias(k) for k in ("amount", "stage", "won", "rating", "owner", "name"))).first()
    assert set(empty) == {""}


def test_step_filters(spark):
    df = spark.createDataFrame([(1, "Abc", "5", "2026-01-01 00:00:00"), (2, "abc", "50", None), (3, None, None, "2026-06-01 12:00:00")], "id int, t string, n string, at string")
    got = lambda c: [r.id for r in df.where(F.coalesce(c, F.lit(False))).orderBy("id").collect()]
    assert got(leaf_condition(F.col("t"), "TEXT", "CONTAINS", "b")) == [1, 2] and got(leaf_condition(F.col("t"), "TEXT", "CONTAINS", "A")) == [1]
    assert got(leaf_condition(F.col("n"), "NUMBER", "GREATER_THAN_OR_EQUAL", "6")) == [2] and got(leaf_condition(F.col("at"), "DATE_TIME", "IS_AFTER", "2026-06-01 11:00:00")) == [3]
    assert got(leaf_condition(F.col("t"), "TEXT", "IS", None)) == [3]
    tree = step_condition([{"id": "a", "op": "OR"}, {"id": "b", "parent": "a", "op": "AND"}], [{"group": "a", "left": F.col("t"), "kind": "TEXT", "operand": "IS", "right": "Abc"}, {"group": "b", "left": F.col("n"), "kind": "NUMBER", "operand": "IS", "right": 50}])
    assert got(tree) == [1, 2]
    assert [r.b for r in df.select(first_branch([("x", F.col("id") > 2), ("y", F.col("id") > 1)], "z").alias("b"), "id").orderBy("id").collect()] == ["z", "y", "x"]


def test_stage_intervals_and_renames(spark):
    at = lambda d, h=8: dt.datetime(2026, 8, d, h)
    log = [("r", at(5), 1, "NEW", "SCREENING", "event"), ("r", at(15), 2, "SCREENING", "PROPOSAL", "event"), ("w", at(20), 3, "NEW", "MEETING", "event"), ("m", at(4), 4, None, "A", "import"), ("m", at(6), 5, "A", "B", "event"), ("m", at(7), 6, "A", "C", "migration"), ("m", at(8), 7, "B", "A", "event"), ("m", at(9), 8, "A", None, "migration")]
    changes = spark.createDataFrame(log, "record_id string, at timestamp, seq long, before string, after string, kind string")
    records = spark.createDataFrame([("r", at(1), None, "PROPOSAL"), ("w", at(10), None, "MEETING"), ("l", at(22), None, "PROPOSAL"), ("d", at(22), at(23), "SCREENING"), ("m", None, None, None)], "record_id string, created_at timestamp, deleted_at timestamp, value string")
    got = {}
    for r in timeline.stage_intervals(changes, records).orderBy("record_id", "k").collect():
        got.setdefault(r.record_id, []).append((r.stage, r.start, r.end, r.basis))
    assert got["r"] == [("NEW", at(1), at(5), "crm_created_at"), ("SCREENING", at(5), at(15), "event"), ("PROPOSAL", at(15), None, "event")]
    assert got["l"] == [("PROPOSAL", at(22), None, "crm_created_at")] and got["d"] == [("SCREENING", at(22), at(23), "crm_created_at")]
    # A rename changes what came before it; one to nothing also ends the stage.
    assert got["m"] == [("C", at(4), at(6), "import"), ("B", at(6), at(8), "event"), (None, at(8), at(9), "event")]
    live = timeline.stage_intervals(changes.where("record_id <> 'm'"), records.where("record_id not in ('m', 'd')"))
    summary = {r.stage: r for r in timeline.time_in_stage(live, F.lit("2026-08-25 08:00:00").cast("timestamp")).collect()}
    assert summary["SCREENING"].completed_intervals == 1 and summary["SCREENING"].average_days_completed == 10
    assert summary["PROPOSAL"].records_in_stage == 2 and summary["PROPOSAL"].average_days_now == Decimal("6.50") and summary["NEW"].completed_intervals == 2


def test_records_with_renamings_only_keep_their_stage(spark):
    at = lambda d: dt.datetime(2026, 8, d)
    log = [("A", at(3), 1, "OLD", "NOW", "migration"), ("B", at(4), 2, "X", "Y", "event"), ("B", at(5), 3, "Y", "Z", "migration"), ("C", at(4), 4, None, "Y", "event"), ("E", at(2), 5, None, None, "event"), ("E", at(3), 6, "P", "Q", "event"), ("E", at(4), 7, "Q", "R", "migration"), ("E", at(5), 8, "R", "S", "migration"), ("E", at(6), 9, "S", "T", "migration"), ("F", at(4), 10, None, None, "event"), ("G", at(4), 11, "GONE", None, "migration")]
    changes = spark.createDataFrame(log, "record_id string, at timestamp, seq long, before string, after string, kind string")
    records = spark.createDataFrame([(k, at(1), None, v) for k, v in (("A", "NOW"), ("B", "Z"), ("C", "Y"), ("D", "NOW"), ("E", "T"), ("F", "W"), ("G", ""), ("H", None))], "record_id string, created_at timestamp, deleted_at timestamp, value string")
    got = {}
    for r in timeline.stage_intervals(changes, records).orderBy("record_id", "k").collect():
        got.setdefault(r.record_id, []).append((r.stage, r.start, r.end, r.basis))
    born = "crm_created_at"
    assert got == {
        "A": [("NOW", at(1), None, born)], "B": [("X", at(1), at(4), born), ("Z", at(4), None, "event")], "C": [("Y", at(4), None, "event")], "D": [("NOW", at(1), None, born)],
        "E": [("P", at(1), at(3), born), ("T", at(3), None, "event")], "F": [("W", at(1), None, born)],
    }
    assert timeline.stage_intervals(changes.limit(0), records.limit(0)).count() == 0


def test_model_refuses_what_it_should():
    bad = [{"objects": {"a": {"labelField": "x", "fields": {}}}}, {"objects": {"a": {"fields": {"name": {"type": "BLOB"}}}}}, {"objects": {"a": {"fields": {"name": {"type": "TEXT"}, "l": {"type": "RELATION", "relation": {"target": "b"}}}}}}, {"objects": {"a": {"fields": {"name": {"type": "SELECT", "options": [{"value": "A"}, {"value": "A"}]}}}}}]
    for document in bad:
        with pytest.raises(SchemaError):
            Model.from_document(document)


def test_undeclared_columns_are_kept(spark):
    df = spark.createDataFrame([("1", "n", "more")], "crm_id string, name string, hobby string")
    r = DEAL.conform(df).first()
    assert r.name == "n" and r.stage is None and r.extra == {"hobby": '{"hobby":"more"}'}


def test_cascades_reach_the_end_of_long_chains_and_of_circles(spark):
    ensure_checkpoint(spark)
    links = [("part", "parent", str(k), "part", str(k - 1)) for k in range(1, 26)] + [("part", "parent", "0", "part", "25"), ("note", "about", "n", "part", "25"), ("part", "parent", "x", "part", "y")]
    edges = spark.createDataFrame(links, "source_object string, field string, source_id string, target_object string, target_id string")
    start = spark.createDataFrame([("part", "0")], "object string, id string")
    got = [tuple(r) for r in relations.cascade(start, edges, {("part", "parent"): "CASCADE", ("note", "about"): "SET_NULL"}).collect()]
    assert sorted(got) == sorted([("part", str(k), "DESTROY") for k in range(26)] + [("note", "n", "SET_NULL")])


def test_upsert_of_repeated_and_missing_keys(spark):
    records = spark.createDataFrame([(1, "a", "x", None, None)], "k long, name string, note string, crm_deleted_at timestamp, crm_updated_at timestamp")
    rows = spark.createDataFrame([(1, 1, "b", None), (1, 2, None, "z"), (2, 5, "new", "n1"), (2, 6, "newer", None), (2, 6, "newer", None)], "k long, p int, name string, note string")
    stamp = F.lit("2026-01-01").cast("timestamp")
    now, log = changes.upsert(records, rows, "k", ["name", "note"], stamp, order=F.col("p"))
    assert sorted((r.k, r.name, r.note) for r in now.collect()) == [(1, "b", "z"), (2, "newer", "n1")] and sorted((r.k, r.op) for r in log.collect()) == [(1, "update"), (2, "create")]
    now, _ = changes.upsert(records, rows, "k", ["name", "note"], stamp, clear=True, order=F.col("p"))
    assert sorted(((r.k, r.name, r.note) for r in now.collect()), key=repr) == [(1, None, "z"), (2, "newer", None)]
    with pytest.raises(Exception, match="without a key"):
        changes.upsert(records, spark.createDataFrame([(None, 1, "b", None)], rows.schema), "k", ["name"], stamp)[0].collect()
    assert changes.upsert(records, rows.limit(0), "k", ["name"], stamp)[1].count() == 0


def test_erasing_by_a_table(spark):
    rows = [(1, r"Mail Ann.Roth@X.org, or ANN.ROTH@x.org.example"), (2, r"a \E b C:\Energy\Q x"), (3, None), (4, ""), (5, "Zoë ÄRGER, id 77"), (6, "ann.roth")]
    df = spark.createDataFrame(rows, "k long, note string")
    gone = [r"c:\energy\q", r"\E", "ann.roth@x.org", "ann.roth@x.org.example", "Zoë ärger", "77", None, ""]
    table = spark.createDataFrame([(g,) for g in gone], "identifier string")
    want = {1: "Mail [erased], or [erased]", 2: "a [erased] b [erased] x", 3: None, 4: "", 5: "[erased], id [erased]", 6: "ann.roth"}
    assert {r.k: r.note for r in changes.erase_listed(df, "k", ["note"], table).collect()} == want
    assert {r.k: r.note for r in changes.erase(df, ["note"], [g for g in gone if g]).collect()} == want
    assert {r.k: r.note for r in changes.erase_listed(df, "k", ["note"], table.limit(0)).collect()} == dict(rows)
    # Identifiers of one beginning meet a text by their whole length, not by that: else each text met every one of them.
    many = spark.range(20_000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("identifier"))
    notes = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.repeat(F.lit("é"), (F.col("id") % 600).cast("int")), F.lit("CUSTOMER#"), F.lpad((F.col("id") * 2).cast("string"), 6, "0"), F.lit("!")).alias("note"))
    began = time.monotonic()
    erased = changes.erase_listed(notes, "k", ["note"], many).select("k", F.replace("note", F.lit("é"), F.lit("")).alias("note"))
    assert erased.where("note <> if(k < 10000, '[erased]!', 'CUSTOMER#' || lpad(string(k * 2), 6, '0') || '!')").count() == 0
    assert time.monotonic() - began < 120
    log = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 2, {"s": ("x", "late")}), ("a", dt.datetime(2026, 1, 1), 1, {"s": ("o", "x")})], "id string, at timestamp, seq int, changes map<string,struct<old:string,new:string>>")
    base = spark.createDataFrame([("a", "o")], "id string, s string")
    assert changes.replayed(base, log, "id", ["s"]).first().s == "late"
