"""Shapes, permissions, settings and workflow steps on small rows."""

import datetime as dt
import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordwell.context import Context
from recordwell.functions.recurrence import RuleError, cron_pattern
from recordwell.functions.zones import zone_name
from recordwell.operators import aggregates, filters, importing, ingest, permissions, projection, relations, schema_changes, search
from recordwell.schema import Model, SchemaError
from recordwell.sources import config, kinds, sinks
from recordwell.streaming import triggers

MODEL = Model.from_document({"objects": {"deal": {"labelField": "name", "fields": {"name": {"type": "TEXT", "label": "Name"}, "stage": {"type": "SELECT", "label": "Stage", "options": [{"value": "NEW", "label": "New"}, {"value": "WON", "label": "Won"}]}, "amount": {"type": "CURRENCY", "default": {"currencyCode": "CHF"}}, "close": {"type": "DATE", "label": "Close"}, "notes": {"type": "RICH_TEXT"}, "old": {"type": "TEXT", "active": False}, "parts": {"type": "RELATION", "relation": {"target": "deal", "type": "ONE_TO_MANY"}}}}}})
DEAL = MODEL.object("deal")
NOW = Context.at("2026-08-25T08:00:00Z", "Europe/Berlin", me="Ann")


def test_fields_of_views_and_lists():
    assert projection.default_fields(DEAL) == ["name", "stage", "amount", "close"]
    assert projection.wanted_fields(DEAL, " stage, name,stage ") == ["stage", "name"] and projection.wanted_fields(DEAL, " ") == projection.default_fields(DEAL)
    assert projection.view_fields(DEAL, "kanban", shown_elsewhere=("stage",)) == ["name", "amount", "close"] and projection.view_fields(DEAL, "calendar") == ["name"]
    with pytest.raises(SchemaError):
        projection.wanted_fields(DEAL, "nothing")


def test_filters_are_told_and_checked():
    spec = {"op": "AND", "conditions": [{"field": "stage", "operand": "IS", "value": ["NEW", "WON"]}, {"op": "OR", "conditions": [{"field": "close", "operand": "IS_RELATIVE", "value": "PAST_7_DAYS"}, {"field": "name", "operand": "isEmpty"}]}, {"op": "NOT", "conditions": [{"field": "amount", "operand": "GREATER_THAN_OR_EQUAL", "value": 5}]}]}
    assert filters.described(DEAL, spec) == "Stage is New or Won and (Close is in the past 7 day or Name is empty) and not (amount is at least 5)"
    assert filters.described(DEAL, None, "de") == "alle Einträge" and filters.described(DEAL, [{"field": "close", "operand": "IS_RELATIVE", "value": "THIS_1_WEEK"}], "de") == "Close liegt in laufend: Woche"
    assert filters.problems(DEAL, spec) == []
    wrong = [{"field": "stage", "operand": "IS", "value": "LOST"}, {"field": "name", "operand": "IS_TODAY"}, {"field": "close", "operand": "IS_RELATIVE", "value": "SOON"}, {"field": "parts", "operand": "IS_EMPTY"}, {"field": "gone", "operand": "IS"}, {"field": "name", "operand": "RHYMES"}]
    assert [len(filters.problems(DEAL, w)) for w in wrong] == [1] * 6 and len(filters.problems(DEAL, wrong)) == 6
    with pytest.raises(filters.FilterError):
        filters.condition(DEAL, {"op": "XOR", "conditions": []}, NOW)


def test_implied_comparisons_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("a", (5_000_000, "EUR"), "x"), ("b", (7_000_000, "EUR"), None), ("c", None, "y")], "crm_id string, amount struct<amountMicros:long,currencyCode:string>, name string")
    rows.write.parquet(str(tmp_path / "deals"))
    spec = [{"field": "amount", "operand": "GREATER_THAN_OR_EQUAL", "value": "6.5"}]
    out = filters.matching(spark.read.parquet(str(tmp_path / "deals")), DEAL, spec, NOW)
    assert [r.crm_id for r in out.collect()] == ["b"]
    assert "GreaterThanOrEqual(amount.amountMicros,6500000)" in out._jdf.queryExecution().toString()
    named = filters.matching(spark.read.parquet(str(tmp_path / "deals")), DEAL, {"field": "name", "operand": "IS_NOT_EMPTY"}, NOW)
    assert sorted(r.crm_id for r in named.collect()) == ["a", "c"] and "IsNotNull(name)" in named._jdf.queryExecution().toString()


def test_default_currency_and_zero_sums(spark):
    rows = spark.createDataFrame([("a", (5_000_000, "EUR")), ("b", None)], "g string, amount struct<amountMicros:long,currencyCode:string>")
    assert aggregates.default_currency(DEAL, "amount", "EUR") == "CHF" and aggregates.default_currency(DEAL, "name") == ""
    assert {(r.g0, r.currency, r.value) for r in aggregates.money_totals(rows, DEAL, "amount", by=[F.col("g")]).collect()} == {("a", "EUR", Decimal(5)), ("b", "CHF", Decimal(0))}
    assert [tuple(r)[:2] for r in aggregates.money_totals(rows.limit(0), DEAL, "amount").collect()] == [("CHF", Decimal(0))]
    with pytest.raises(aggregates.AggregateError):
        aggregates.chart_order(rows, DEAL, "stage", "sideways")


def test_sums_keep_ten_places(spark):
    of = Model.from_document({"objects": {"n": {"labelField": "x", "fields": {"x": {"type": "NUMBER"}}}}}).object("n")
    rows = spark.createDataFrame([(Decimal("0.0000004"),)] * 5, "x decimal(38,10)")
    from recordwell.functions.values import value

    assert rows.agg(aggregates.aggregate_column("SUM", value(of, "x"))).first()[0] == Decimal("0.000002")


def test_objects_change_their_label_only():
    model = schema_changes.update_object(MODEL, "deal", label="Deals", label_field="stage")
    assert model.object("deal").label == "Deals" and model.object("deal").label_field == "stage" and list(model.object("deal").fields) == list(DEAL.fields)
    with pytest.raises(SchemaError):
        schema_changes.update_object(MODEL, "deal", label_field="parts")


def test_titles_meet_their_own_object(spark):
    rows = spark.createDataFrame([("r", ("deal", "1", "old")), ("s", ("other", "1", "kept"))], "crm_id string, link struct<object:string,id:string,title:string>")
    deals = spark.createDataFrame([("1", "now", None)], "crm_id string, crm_title string, crm_deleted_at timestamp")
    got = {r.crm_id: r.link_now for r in relations.with_titles(rows, "link", deals, "deal").collect()}
    assert got["r"].title == "now" and got["r"].exists and got["s"].title == "kept" and not got["s"].exists


def test_a_long_chain_is_destroyed_to_its_end(spark):
    from recordwell.deploy import ensure_checkpoint

    ensure_checkpoint(spark)
    links = spark.createDataFrame([("deal", "parent", str(k + 1), "deal", str(k)) for k in range(30)], "source_object string, field string, source_id string, target_object string, target_id string")
    start = spark.createDataFrame([("deal", "0")], "object string, id string")
    assert relations.cascade(start, links, {("deal", "parent"): "CASCADE"}).where("action = 'DESTROY'").count() == 31


def test_all_concepts_of_a_query(spark):
    concepts = spark.range(1001).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.array(F.lit("Wind Power")).alias("terms"))
    assert len(search.expand(concepts, "wind power here", concepts)) == 1001 and search.expand(concepts, "windy power", concepts) == []


def test_top_claims(spark):
    rows = spark.createDataFrame([("p", [(str(k), "wind " * (k % 2) + "power", "active") for k in range(12)]), ("q", [("1", "sun", "active"), ("2", "sun", "done")])], "id string, claims array<struct<id:string,text:string,status:string>>")
    got = {r.id: [c.id for c in r.top_claims] for r in search.relevant_claims(rows, "Wind power", F.col("id") == "q").collect()}
    assert got == {"p": ["1", "11", "3", "5", "7", "9", "0", "10"], "q": ["1"]}


def test_permissions(spark):
    roles = {"roles": {"r": {"objects": {"deal": {"update": True, "fields": {"amount": {"update": False}}}, "*": {"read": True}}}}, "assignments": {"bot:*": "r", "bot:x": "none"}}
    ops = spark.createDataFrame([("bot:1", "deal", "create", "name"), ("bot:1", "deal", "update", "amount"), ("bot:1", "deal", "read", None), ("bot:1", "task", "read", None), ("bot:x", "task", "read", None), ("ann", "deal", "destroy", None)], "actor string, object string, action string, field string")
    assert [r.refused for r in permissions.checked(ops, roles).collect()] == [None, "field", "action", None, "action", None]
    assert [r.refused for r in permissions.checked(ops, {**roles, "enforcement": "team"}).collect()][-1] == "no-member"
    assert {r.refused for r in permissions.checked(ops, {}).collect()} == {None}


def test_settings_and_definitions(spark, tmp_path):
    (tmp_path / "views.json").write_text(json.dumps({"v": {"object": "deal", "type": "KANBAN", "groupBy": "stage", "fields": ["name"]}, "w": {"object": "deal", "type": "KANBAN", "groupBy": "name"}, "x": {"object": "none"}, "y": {"object": "deal", "type": "CALENDAR", "fields": ["zip"], "filter": [{"field": "stage", "operand": "IS", "value": "LOST"}]}}))
    views = config.read_document(spark, str(tmp_path / "views.json"))
    found = config.view_problems(MODEL, views)
    assert [sum(p.startswith(n) for p in found) for n in "vwxy"] == [0, 1, 1, 3]
    boards = {"b": {"widgets": [{"object": "deal", "kind": "BAR", "function": "SUM", "field": "amount", "groupBy": "stage", "orderBy": "value"}, {"object": "deal", "kind": "PIE", "function": "MODE"}, {"object": "deal", "kind": "PIE", "orderBy": "up"}]}}
    assert [sum(p.startswith(f"b.{k}") for p in config.dashboard_problems(MODEL, boards)) for k in (1, 2, 3)] == [0, 1, 2]


def test_files_are_dispatched_by_kind(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "b.json").write_text('{"rows": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "c.csv").write_bytes(b"%PDF-1.4 x")
    assert kinds.read_any_table(spark, str(tmp_path / "a.csv")).select("x", "y").first() == ("1", "2")
    assert kinds.read_any_table(spark, str(tmp_path / "b.json"), "rows").count() == 2
    with pytest.raises(ValueError, match="pdf"):
        kinds.read_any_table(spark, str(tmp_path / "c.csv"))


def test_zones_and_schedules(spark):
    names = {"Europe/Vienna": "Europe/Vienna", '"W. Europe Standard Time"': "Europe/Berlin", "/freeassociation.sourceforge.net/Tzfile/Asia/Tokyo": "Asia/Tokyo", "UTC+05:30": "+05:30", "Somewhere": "UTC"}
    rows = spark.createDataFrame([(k,) for k in names], "n string").select("n", zone_name(F.col("n")).alias("z")).collect()
    assert {r.n: r.z for r in rows} == names
    assert cron_pattern({"type": "HOURS", "schedule": {"hour": 4, "minute": 5}}) == "5 */4 * * *" and cron_pattern({"pattern": "0 1 * * *"}) == "0 1 * * *" and cron_pattern({"type": "MINUTES", "schedule": {"minute": 15}}) == "*/15 * * * *"
    for bad in ({"type": "DAYS", "schedule": {"day": 0, "hour": 1, "minute": 1}}, {"type": "HOURS", "schedule": {"hour": True, "minute": 1}}, {"type": "WEEKS"}):
        with pytest.raises(RuleError):
            cron_pattern(bad)


def test_cells_of_an_import_are_read_once(spark):
    of = Model.from_document({"objects": {"deal": {"labelField": "name", "fields": {"name": {"type": "TEXT"}, "amount": {"type": "CURRENCY"}}}}}).object("deal")
    made = importing.coerced(spark.createDataFrame([(1, " 12.50 EUR "), (2, " "), (3, None), (4, "12,x")], "row_no int, amount string"), of, {"amount": "amount"})
    assert [(r.row_no, r.amount and r.amount.amountMicros, [e.rule for e in r.errors]) for r in made.sort("row_no").collect()] == [(1, 12_500_000, []), (2, None, []), (3, None, []), (4, None, ["currency"])]
    # A cell's text that is a common expression of its own hides that the parts of its reading are the same.
    assert not re.search(r"trim\(amount[^)]*\) AS _common_expr", made._jdf.queryExecution().optimizedPlan().toString())


def test_matching_on_several_keys(spark):
    records = spark.createDataFrame([("1", None, "a@x.org", "1"), ("2", None, "a@x.org", "2"), ("3", dt.datetime(2020, 1, 1), "b@x.org", "3"), ("4", None, None, "4")], "crm_id string, crm_deleted_at timestamp, mail string, code string")
    rows = spark.createDataFrame([(1, "A@x.org", None), (2, "a@x.org", "2"), (3, None, None), (4, "b@x.org", None), (5, None, "4"), (6, "c@x.org", "4")], "row_no int, m string, c string")
    keys, kinds_ = {"m": "mail", "c": "code"}, {"m": "EMAILS"}
    got = {r.row_no: (r.n_matches, r.matched_id) for r in importing.matched_on(rows, records, keys, kinds_).collect()}
    assert got == {1: (2, "1"), 2: (1, "2"), 3: (0, None), 4: (0, None), 5: (1, "4"), 6: (0, None)}
    assert {r.row_no: r.n_matches for r in importing.matched_on(rows, records, keys, kinds_, trash=True).collect()}[4] == 1


def test_first_messages_unite_their_handles(spark):
    rows = spark.createDataFrame([("m", 2, ["B@x", "c@x"], "later"), ("m", 1, ["a@x", "b@x"], "first"), ("n", 3, [], "alone")], "key string, position int, handles array<string>, subject string")
    got = {r.key: (r.subject, r.handles, r.n_copies) for r in ingest.first_messages(rows).collect()}
    assert got == {"m": ("first", ["a@x", "b@x", "c@x"], 2), "n": ("alone", [], 1)}


def test_iterations_and_plans_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(triggers, "ITEMS", 3)
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"] * 4), ("c", [])], "run_id string, items array<string>")
    got = sorted((r.run_id, r.failed, r.item_no, r["item"]) for r in triggers.iterated(rows).collect() if r.failed is None) + [r.run_id for r in triggers.iterated(rows).collect() if r.failed]
    assert got == [("a", None, 0, "x"), ("a", None, 1, "y"), "b"]
    runs = spark.range(20).select(F.lit("w").alias("workflow"), F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.col("id") % 7).alias("at"))
    now, later = triggers.planned(runs, 6)
    assert now.count() == 6 and later.count() == 14 and now.unionByName(later).distinct().count() == 20


def test_turns_are_dealt_from_one_partitioning(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"))
    got = {r.n: r.picked for r in triggers.round_robin(rows, [F.col("n")], ["a", "b", "c"], start=2).collect()}
    assert all(got[k] == "abc"[(k + 2) % 3] for k in range(1000))


def test_delayed_runs_resume_in_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 10, m)
    schema = "run_id string, entered_at timestamp, resume_at timestamp"
    for k, rows in enumerate(([("a", at(0), at(5)), ("b", at(1), dt.datetime(2026, 1, 2))], [("c", at(59), dt.datetime(2026, 1, 3))], [("d", at(59), dt.datetime(2026, 1, 3))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = triggers.delay_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cursor")).trigger(availableNow=True).start().awaitTermination()
        assert k >= 0
    assert {r.run_id for r in spark.read.schema("run_id string, outcome string").parquet(str(tmp_path / "out")).collect()} == {"a"}


def test_record_files_are_equal_for_equal_content(spark):
    of = MODEL.object("deal").without("parts")
    rows = of.conform(spark.createDataFrame([("1", "A: b", "NEW", "z", 1)], "crm_id string, name string, stage string, zz string, aa int"))
    text = rows.withColumn("body", F.lit("Hi")).select(sinks.record_text(of)).first()[0]
    assert text.startswith("---\ncrm_id: 1\nname: \"A: b\"\nstage: NEW\n") and text.endswith("\n---\nHi") and text.index("aa: ") < text.index("zz: ")


def test_mappings_are_suggested():
    people = Model.from_document({"objects": {"person": {"labelField": "firstName", "fields": {"firstName": {"type": "TEXT"}, "lastName": {"type": "TEXT", "label": "Family"}, "emails": {"type": "EMAILS"}, "city": {"type": "TEXT"}}}, "deal": {"labelField": "name", "fields": {"name": {"type": "TEXT"}, "amount": {"type": "CURRENCY"}}}}})
    headers = ["Vorname", "family", "E-Mail-Adresse", "Ort", "first name", "Notes"]
    assert importing.suggested_mapping(headers, people.object("person")) == {"Vorname": "firstName", "family": "lastName", "E-Mail-Adresse": "emails", "Ort": "city"}
    assert importing.suggested_object(headers, list(people.objects.values())) == "person" and importing.suggested_object(["Firma", "Amount"], list(people.objects.values())) == "deal" and importing.suggested_object(["x"], list(people.objects.values())) is None


def test_merges_join_texts_and_keep_wishes(spark):
    from recordwell.operators import changes

    rows = spark.createDataFrame([("1", "A", " one "), ("2", "B", "two"), ("3", "C", "one"), ("4", "D", None)], "id string, name string, note string")
    groups = spark.createDataFrame([("g", "1", 1, None), ("g", "2", 2, ["name"]), ("g", "3", 3, None)], "group_id string, id string, rank int, wins array<string>")
    out, ids = changes.merge(rows, groups, "id", ["name"], texts=["note"])
    assert {tuple(r) for r in out.select("id", "name", "note").collect()} == {("1", "B", "one\n\ntwo"), ("4", "D", None)} and {tuple(r) for r in ids.collect()} == {("2", "1"), ("3", "1")}
