"""Files in and out, pages, schema changes, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordwell.context import Context
from recordwell.operators import changes, graph, importing, pages, schema_changes
from recordwell.plans import crm
from recordwell.schema import Field, Model, ObjectType, Option, SchemaError
from recordwell.sources import records, sinks
from recordwell.sources.mail import read_messages
from recordwell.streaming import triggers

PAGE = """---
title: "First page"
tags:
  - Ärger
  - b
status: active
aliases: [one, 'two']
nested:
  key: value
---
# Head
[[wiki/second|Second]] and [[gone#x]]
<!-- claim id=c1 kind=fact status=active sources=s1,s2 -->
Water is wet.
<!-- /claim -->
"""


@pytest.fixture
def wiki(spark, tmp_path):
    folder = tmp_path / "vault"
    (folder / "wiki").mkdir(parents=True)
    (folder / "wiki" / "first.md").write_text(PAGE)
    (folder / "wiki" / "second.md").write_text("No head here")
    return records.read_pages(spark, str(folder))


def test_pages(wiki):
    a, b = wiki.orderBy("path").collect()
    assert a.path == "wiki/first.md" and a.data["title"] == ["First page"] and a.data["tags"] == ["Ärger", "b"] and a.data["aliases"] == ["one", "two"] and a.is_list["tags"] and not a.is_list["title"] and a.bad_lines == 1
    assert b.data == {} and b.body == "No head here"
    c = pages.claims(wiki).first()
    assert (c.claim_id, c.kind, c.status, c.sources, c.text) == ("c1", "fact", "active", ["s1", "s2"], "Water is wet.")
    edges = graph.resolved_edges(graph.link_edges(wiki), wiki)
    assert {tuple(r) for r in edges.collect()} == {("wiki/first.md", "wiki/second", "wiki/second.md"), ("wiki/first.md", "gone", None)}
    assert [r.path for r in graph.orphan_pages(wiki, edges).collect()] == ["wiki/first.md"] and graph.broken_links(edges).count() == 1


def test_page_edits(wiki):
    act = lambda **a: {r.path: r.data for r in pages.edited(wiki, F.lit(True), a).collect()}["wiki/first.md"]
    assert act(action="normalize_values", property="tags", steps=["strip_diacritics", "lowercase"], mapping={"b": "c"})["tags"] == ["arger", "c"]
    assert act(action="copy", property="title", to="heading")["heading"] == ["First page"] and "title" not in act(action="rename", property="title", to="x")
    assert act(action="merge", property="aliases", to="tags")["tags"] == ["Ärger", "b", "one", "two"]
    assert act(action="set", property="title", value="No", mode="skip")["title"] == ["First page"] and act(action="set", property="n", value=["a"])["n"] == ["a"]
    assert "tags" not in act(action="delete", property="tags")
    with pytest.raises(ValueError, match="unknown action"):
        pages.edited(wiki, F.lit(True), {"action": "burn", "property": "x"})
    for operator, want in {"exists": 1, "not_exists": 1, "starts_with": 1, "is_empty": 1, "is_string": 1}.items():
        assert wiki.where(pages.selector({"kind": "filter", "conditions": [{"property": "title", "operator": operator, "value": "First"}]})).count() == want
    assert wiki.where(pages.selector({"kind": "paths", "paths": ["wiki/second.md"]})).count() == 1 and wiki.where(pages.selector({"kind": "all"})).count() == 2


def test_record_files(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "a1.md").write_text("---\nname: Acme\nclose: soon\namount.amountMicros: 5000000\namount.currencyCode: EUR\n---\n")
    of = Model.from_document({"objects": {"deal": {"labelField": "name", "fields": {"name": {"type": "TEXT"}, "close": {"type": "DATE"}, "amount": {"type": "CURRENCY"}}}}}).object("deal")
    r = records.read_records(spark, str(folder), of).first()
    assert r.crm_id == "a1" and r.name == "Acme" and r.amount.amountMicros == 5_000_000 and r.close is None and r.unread == ["close"]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Name;Betrag;;Name\n"A; ""x""\nzwei";1,5;;q\nB;2;;\nC;1;2;3;4;5\n')
    rows = records.read_table(spark, str(tmp_path / "t.csv")).orderBy("row_no").collect()
    assert list(rows[0].asDict())[:4] == ["Name", "Betrag", "(column 3)", "Name (2)"] and rows[0]["Name"] == 'A; "x"\nzwei' and [r.broken for r in rows] == [False, False, True]
    (tmp_path / "w.csv").write_bytes("Ort,Land\nMünchen €,DE\n".encode("cp1252"))
    assert records.read_table(spark, str(tmp_path / "w.csv")).first().Ort == "München €"
    (tmp_path / "s.csv").write_text("sep=|\na|b\n")
    assert records.sniff_table("sep=|\na|b\n") == {"sep": "|", "skip": "1"} and records.sniff_table("a\tb\n1\t2")["sep"] == "\t"
    shapes = [[{"id": 1}], {"data": {"people": {"edges": [{"node": {"id": 1}}]}}}, {"data": {"people": [{"id": 1}]}}, {"people": [{"id": 1}]}]
    for k, shape in enumerate(shapes):
        (tmp_path / f"{k}.json").write_text(json.dumps(shape))
        assert [r.id for r in records.read_json_table(spark, str(tmp_path / f"{k}.json"), None if k == 0 else "people").collect()] == [1]


def test_tables_are_decoded_by_all_their_bytes(spark, tmp_path):
    rows = "".join(f"{k};plain\n" for k in range(200))
    (tmp_path / "late.csv").write_bytes(f"Größe;Ort\n{rows}201;München €\n".encode("cp1252"))
    got = records.read_table(spark, str(tmp_path / "late.csv"))
    assert got.columns[:2] == ["Größe", "Ort"] and got.where("`Größe` = '201'").first().Ort == "München €" and got.count() == 201
    (tmp_path / "new.csv").write_text(f"Größe;Ort\n{rows}201;München € \ufffd\n", encoding="utf-8")
    assert records.read_table(spark, str(tmp_path / "new.csv")).where("`Größe` = '201'").first().Ort == "München € \ufffd"


def test_mailboxes_are_dealt_by_message(spark, tmp_path):
    for name, end in (("a.mbox", "\n"), ("b.MBX", "\r\n")):
        text = "".join(f"From x Mon Jan  5\nSubject: {name} {k}\n\nGrüße {k}\n>From here\n\n" for k in range(300))
        (tmp_path / name).write_bytes(text.replace("\n", end).encode("latin-1"))
    (tmp_path / "c.eml").write_bytes(b"Subject: single\n\nbody\n")
    limits = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.sources.binaryFile.maxLength": "1000"}  # a mailbox read whole would fail
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = read_messages(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.subject for r in got) == sorted([f"{n} {k}" for n in ("a.mbox", "b.MBX") for k in range(300)] + ["single"])
    assert len({r.task for r in got if r.path.endswith("a.mbox")}) > 1 and all(r.error is None and r.text.rstrip().endswith("From here") for r in got if r.subject != "single")


def test_events(spark, tmp_path):
    (tmp_path / "2026-01.jsonl").write_text('{"event_id":"e1","at":"2026-01-05T10:00:00Z","op":"update","object":"deal","record_id":"r","changes":{"stage":["A","B"]}}\n')
    r = records.read_events(spark, str(tmp_path)).first()
    assert r.changes["stage"].old == "A" and r.changes["stage"].new == "B" and r.shard == "2026-01.jsonl"


def test_messages(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: Ann <ANN@x.org>\r\nTo: b@y.org, c@z.org\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nMessage-ID: <1@x>\r\nReferences: <0@x> <9@x>\r\nDate: Mon, 05 Jan 2026 10:00:00 +0200\r\nList-Id: l\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHallo\r\n")
    (tmp_path / "b.mbox").write_bytes(b"From a Mon Jan  5\nSubject: one\n\nbody one\n\nFrom b Mon Jan  5\nSubject: two\n\nbody two\n")
    got = {r.subject: r for r in read_messages(spark, str(tmp_path)).collect()}
    assert set(got) == {"Grüße", "one", "two"} and got["Grüße"].sender == "ann@x.org" and got["Grüße"].recipients == ["b@y.org", "c@z.org"] and got["Grüße"].references == ["<0@x>", "<9@x>"] and got["Grüße"].bulk and got["Grüße"].sent_at == dt.datetime(2026, 1, 5, 8)
    assert got["two"].text.strip() == "body two"


def test_exports(spark, tmp_path):
    df = crm.opportunities(spark, "/root/testdata/sf0.001")
    sinks.write_json(df, str(tmp_path / "j"), crm.OPPORTUNITY)
    assert spark.read.json(str(tmp_path / "j")).count() == df.count()
    plain = df.orderBy("o_orderkey").select(*sinks.plain_columns(crm.OPPORTUNITY, crm.NOW, "DOTS_AND_COMMA")).first()
    assert plain.amount == "EUR" or "," in plain.amount
    events = spark.createDataFrame([("1", dt.datetime(2026, 1, 2)), ("2", dt.datetime(2026, 2, 2))], "event_id string, at timestamp")
    sinks.append_events(events, str(tmp_path / "log"))
    assert {p.name for p in (tmp_path / "log").iterdir() if p.is_dir()} == {"month=2026-01", "month=2026-02"}
    assert "amount.amountMicros" in sinks.sample_row(crm.OPPORTUNITY)


def test_schema_changes():
    m = schema_changes.add_option(crm.MODEL, "opportunity", "stage", Option("LOST"), 1)
    assert m.object("opportunity").fields["stage"].values[:2] == ["F", "LOST"]
    m = schema_changes.rename_option(m, "opportunity", "stage", "LOST", "GONE")
    assert m.object("opportunity").fields["stage"].options[1].previous == ("LOST",) and m.fingerprint() != crm.MODEL.fingerprint()
    for call in (
        lambda: schema_changes.add_option(m, "opportunity", "stage", Option("LOST")), lambda: schema_changes.remove_option(m, "opportunity", "stage", "GONE", None, used=True), lambda: schema_changes.delete_field(m, "company", "name"),
        lambda: schema_changes.set_active(m, "company", "name", False), lambda: schema_changes.add_field(m, "company", Field("x", "TEXT", nullable=False), 3), lambda: schema_changes.add_object(m, ObjectType("company", "name")),
    ):
        with pytest.raises(SchemaError):
            call()
    less = schema_changes.delete_object(m, "company")
    assert "company" not in less.objects["opportunity"].fields
    assert schema_changes.uses({"v1": {"object": "deal", "sort": [{"field": "amount.amountMicros"}]}, "v2": {"object": "task"}}, "deal", "amount") == ["v1"]


def test_writes(spark):
    rows = spark.createDataFrame([("1", "a", None), ("2", "a", "x"), ("3", None, "y")], "crm_id string, name string, note string")
    assert {r.key: r.n for r in changes.unique_violations(rows, F.col("name")).collect()} == {"a": 2}
    log = spark.createDataFrame([("1", "update", {"name": ("a", "b")})], "k string, op string, changes map<string,struct<old:string,new:string>>")
    back = changes.reverted(log).first()
    assert back.changes["name"].old == "b" and back.op == "update"
    hashes = [r.plan_sha256 for r in changes.plan_hash(rows).collect()]
    assert len(set(hashes)) == 3
    kinds = {r.column: r.kind for r in importing.column_kinds(spark.createDataFrame([("1.5", "ja", "a@b.c", "1.2.2024", "hello", None)], "n string, f string, m string, d string, t string, e string")).collect()}
    assert kinds == {"n": "number", "f": "boolean", "m": "email", "d": "date", "t": "text", "e": "empty"}
    links = importing.resolved_links(spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "k string"), spark.createDataFrame([("1", "a", None), ("2", "b", None), ("3", "b", None), ("4", "c", dt.datetime(2026, 1, 1))], "crm_id string, t string, crm_deleted_at timestamp"), "k", "t")
    assert {r.k: r.link_rule for r in links.collect()} == {"a": None, "b": "relation-ambiguous", "c": "relation-deleted", "d": "relation-not-found", None: None}


def test_triggers_stream_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda k, minute, stage: json.dumps({"event_id": k, "at": f"2026-01-01T10:{minute:02d}:00Z", "op": "update", "object": "deal", "record_id": "r", "changes": {"stage": ["A", stage]}})
    (source / "2026-01.jsonl").write_text("\n".join([line("1", 1, "B"), line("2", 2, "B"), line("3", 3, "C")]) + "\n")
    rule = [triggers.Trigger("w", "deal", ("update",), ("stage",))]

    def once() -> int:
        events = records.read_events(spark, str(source), stream=True).withColumn("depth", F.lit(0))
        out = triggers.runs(events, rule)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cursor")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert once() == 2
    (source / "2026-02.jsonl").write_text(line("4", 4, "C") + "\n" + line("5", 5, "D") + "\n")
    assert once() == 3  # the cursor moved on; C within the watermark counts once


def test_waits_resume_or_time_out(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "record_id string, at timestamp, kind string, run_id string, seconds long"

    def put(k, rows):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("record_id", "at", "kind", "run_id", "seconds"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        q = triggers.waits(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(1, [("a", "2026-01-01T10:00:00Z", "wait", "r1", 3600), ("b", "2026-01-01T10:00:00Z", "wait", "r2", 60)])
    put(2, [("a", "2026-01-01T10:30:00Z", "event", None, None), ("z", "2026-01-01T12:00:00Z", "event", None, None)])
    put(3, [("z", "2026-01-01T13:00:00Z", "event", None, None)])
    assert {(r.run_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("r1", "resumed"), ("r2", "timed-out")}


def test_several_runs_wait_on_one_record(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(k, rows):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("record_id", "at", "kind", "run_id", "seconds"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema("record_id string, at timestamp, kind string, run_id string, seconds long").json(str(source))
        triggers.waits(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    def found():
        return sorted((r.record_id, r.run_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(1, [("a", "2026-01-01T10:00:00Z", "wait", "r1", 60), ("a", "2026-01-01T10:01:00Z", "wait", "r2", 7200), ("b", "2026-01-01T10:00:00Z", "wait", "r3", 60), ("b", "2026-01-01T10:00:00Z", "wait", "r4", 36000)])
    put(2, [("a", "2026-01-01T10:02:00Z", "wait", "r5", 3600)])
    put(3, [("a", "2026-01-01T10:30:00Z", "event", None, None), ("z", "2026-01-01T12:00:00Z", "event", None, None)])
    put(4, [("z", "2026-01-01T13:00:00Z", "event", None, None)])
    first = [("a", "r1", "timed-out"), ("a", "r2", "resumed"), ("a", "r5", "resumed"), ("b", "r3", "timed-out")]
    assert found() == first
    put(5, [("b", "2026-01-01T14:00:00Z", "event", None, None)])
    assert found() == [*first, ("b", "r4", "resumed")]


def test_first_match_chains(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "a boolean, b boolean")
    no = F.lit(False)
    assert [r[0] for r in df.select(importing.message_reason(no, F.col("a"), no, F.col("b"), no)).collect()] == ["blocklist", "bulk", "keep"]
    assert [r[0] for r in df.select(importing.address_reason(no, no, F.col("a"), no, no, F.col("b"), no)).collect()] == ["free_email", "group_address", ""]
    assert [r[0] for r in df.select(pages.trust_tier(F.when(F.col("a"), "human:x").when(F.col("b"), "agent:y"))).collect()] == ["human-reviewed", "machine-confirmed", "unverified"]
    assert Context.at("2026-01-01T00:00:00Z").zone_name == "UTC"


def test_workbooks(spark, tmp_path):
    import zipfile

    from recordwell.sources.workbooks import read_workbooks

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Hidden" state="hidden" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Name</t></si><si><r><t>Ä</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45366</v></c><c r="C3"><v>2.0099999999999998</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" s="2"><v>45366.5</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = read_workbooks(spark, str(tmp_path)).orderBy("path", "row_no").collect()
    assert [(r.sheet, r.row_no, r.cells) for r in rows[:2]] == [("Data", 1, ["Name", None, "x"]), ("Data", 3, ["Äb", "2024-03-15", "2.01", "true", "2024-03-15 12:00:00"])]
    assert rows[2].error and rows[2].cells is None
