"""Imports of tables into records: coercion with row errors, duplicates in the file, matching, actions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_day
from ..functions.numbers import parse_bool, parse_list, parse_money, parse_number
from ..functions.text import casefold, is_blocklisted, normalize_email, phone_key, secret_kinds, url_key
from ..schema import PRIMARY, ObjectType

ERROR = "struct<column:string,rule:string,message:string>"


#: What the primary part of a composite field looks like: (rule, pattern).
SHAPES = {"EMAILS": ("email", r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"), "LINKS": ("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^\s/]+\.[^\s/]+.*$"), "PHONES": ("phone", r"^[+(]?[0-9][0-9 ()/.\-]*$")}


def error(column: str, rule: Column, message: str) -> Column:
    return F.when(rule.isNotNull(), F.struct(F.lit(column).alias("column"), rule.cast("string").alias("rule"), F.lit(message).alias("message")))


def coerced(df: DataFrame, of: ObjectType, mapping: dict[str, str], point: str = ".", slash_order: str | None = None) -> DataFrame:
    """df (text columns, and `row_no`) with the mapped fields typed and `errors`, an array of what is wrong in a row."""
    parsed: dict[str, Column] = {}  # each cell is read once, in a projection of its own
    typed: dict[str, Column] = {}
    errors: list[Column] = []
    for n, (source, key) in enumerate(mapping.items()):
        # Not by nullif: generated code then no longer shares the repeated parts of what reads the text.
        trimmed = F.trim(F.col(source))
        m, text = of.resolve(key), F.when(trimmed != "", trimmed)
        at, empty = f"cell_{n}", text.isNull()
        cell = F.col(at)
        typed[key], rule = cell, F.lit(None)
        if m.type in ("NUMBER", "NUMERIC"):
            parsed[at] = parse_number(text, point)
            typed[key], rule = (cell.number if m.type == "NUMBER" else cell.number.cast("string")), cell.rule
        elif m.type == "CURRENCY":
            parsed[at] = parse_money(text, point)
            typed[key], rule = F.when(cell.amountMicros.isNotNull(), F.struct(cell.amountMicros.alias("amountMicros"), cell.currencyCode.alias("currencyCode"))), cell.rule
        elif m.type == "BOOLEAN":
            parsed[at] = parse_bool(text)
            typed[key], rule = cell.flag, cell.rule
        elif m.type in ("DATE", "DATE_TIME"):
            parsed[at] = parse_day(text, slash_order)
            typed[key], rule = (cell.day if m.type == "DATE" else cell.day.cast("timestamp")), cell.rule
        elif m.type == "SELECT":
            parsed[at] = F.try_element_at(_option_map(m.field), casefold(text))
            rule = F.when(~empty & cell.isNull(), "select-option")
        elif m.type == "MULTI_SELECT":
            parsed[at] = _options_of(m.field, text)
            typed[key], rule = F.array_distinct(cell), F.when(F.exists(cell, lambda x: x.isNull()), "select-option")
        elif m.type == "RAW_JSON":
            parsed[at] = text
            rule = F.when(~empty & F.try_parse_json(cell).isNull(), "json")
        elif m.type == "UUID":
            parsed[at] = text
            rule = F.when(~cell.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid")
        elif m.type == "RATING":
            parsed[at] = F.when(text.rlike("^[1-5]$"), F.concat(F.lit("RATING_"), text)).otherwise(F.upper(text))
            rule = F.when(~cell.rlike("^RATING_[1-5]$"), "rating")
        elif m.type in SHAPES and (m.sub or PRIMARY[m.type]) == PRIMARY[m.type]:
            parsed[at] = normalize_email(text) if m.type == "EMAILS" else text
            rule = F.when(~cell.rlike(SHAPES[m.type][1]), SHAPES[m.type][0])
        else:
            parsed[at] = parse_list(text) if m.type == "ARRAY" else text
        secret = F.when(F.size(secret_kinds(text)) > 0, "credential") if m.type in ("TEXT", "RICH_TEXT", "RAW_JSON") else F.lit(None)
        errors.append(error(source, secret.cast("string"), "looks like a password or key"))
        errors.append(error(source, rule, f"not a {m.type.lower()}"))
        if m.field and not m.field.nullable:
            errors.append(error(source, F.when(empty, "required"), "a value is needed"))
    made = F.filter(F.array(*errors), lambda x: x.isNotNull()).cast(f"array<{ERROR}>") if errors else F.array().cast(f"array<{ERROR}>")
    cells = df.select("*", *(c.alias(k) for k, c in parsed.items()))
    return cells.select("row_no", *(c.alias(k.replace(".", "_")) for k, c in typed.items()), made.alias("errors"))


def _option_map(f) -> Column:
    """Folded values and labels to values; labels first, so a value wins over another's label."""
    pairs = {o.label.casefold(): o.value for o in f.options} | {o.value.casefold(): o.value for o in f.options}
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)) if pairs else F.create_map().cast("map<string,string>")


def _options_of(f, text: Column) -> Column:
    options = _option_map(f)
    return F.transform(parse_list(text), lambda x: F.try_element_at(options, casefold(x)))


def unique_key(kind: str, text: Column) -> Column:
    """The form in which a unique field's values are compared."""
    return {"EMAILS": normalize_email, "LINKS": url_key, "PHONES": phone_key}.get(kind, lambda t: casefold(F.trim(t)))(text)


def file_duplicates(df: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """df with `duplicate`: null, 'duplicate-ignored' for a later row equal to the first, or 'duplicate-in-file' for all rows of a
    key whose rows differ. Rows are compared by aggregates of their key, so a frequent key isn't gathered."""
    sig = df.withColumn("sig", F.xxhash64(*signature))
    about = sig.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("row_no").alias("first_row"), F.min("sig").alias("low"), F.max("sig").alias("high"), F.count(F.lit(1)).alias("n"))
    joined = sig.join(about.where("n > 1"), key, "left")
    mark = F.when(F.col("low") != F.col("high"), "duplicate-in-file").when(F.col("row_no") > F.col("first_row"), "duplicate-ignored")
    return joined.withColumn("duplicate", mark).drop("sig", "first_row", "low", "high", "n")


def matched(rows: DataFrame, records: DataFrame, row_key: str, record_key: str, mode: str = "upsert") -> DataFrame:
    """rows with (matched_id, action): records (crm_id, crm_deleted_at, key) are found by key.

    action: create, update, restore (in the trash), or an error of the row: exists, match-missing, not-found,
    match-conflict (several records).
    """
    found = records.where(F.col(record_key).isNotNull()).groupBy(F.col(record_key).alias("m_key")).agg(F.min("crm_id").alias("matched_id"), F.count(F.lit(1)).alias("m_n"), F.count_if(F.col("crm_deleted_at").isNull()).alias("m_live"))
    joined = rows.join(found, F.col(row_key) == F.col("m_key"), "left")
    hit = F.col("m_n").isNotNull()
    action = (
        F.when(F.col(row_key).isNull(), F.lit("match-missing") if mode == "update" else F.lit("create"))
        .when(F.coalesce("m_n", F.lit(0)) > 1, "match-conflict")
        .when(hit & F.lit(mode == "create"), "exists")
        .when(~hit & F.lit(mode == "update"), "not-found")
        .when(hit & (F.col("m_live") == 0), "restore")
        .when(hit, "update")
        .otherwise("create")
    )
    return joined.withColumn("action", action).drop("m_key", "m_n", "m_live")


def matched_on(rows: DataFrame, records: DataFrame, keys: dict[str, str], kinds: dict[str, str], trash: bool = False) -> DataFrame:
    """rows (row_no, ...) with (n_matches, matched_id): records that agree in every key that the row gives.

    keys: row column to record column; kinds: a key's field type, whose normal form is compared. Rows that give no key match
    nothing. Rows are grouped by the keys that they give; each group is one equi-join, so no pair is tested in vain.
    """
    normal = {k: F.nullif(unique_key(kinds.get(k, "TEXT"), F.col(k).cast("string")), F.lit("")) for k in keys}
    marked = rows.withColumns({f"m_{k}": c for k, c in normal.items()}).withColumn("m_given", F.concat(*(F.when(F.col(f"m_{k}").isNotNull(), F.lit("1")).otherwise("0") for k in keys)))
    there = records if trash else records.where("crm_deleted_at is null")
    there = there.select("crm_id", *(F.nullif(unique_key(kinds.get(k, "TEXT"), F.col(c).cast("string")), F.lit("")).alias(f"r_{k}") for k, c in keys.items()))
    # One row for each way to give keys: the record's values of those keys, null for the others.
    ways = range(1, 1 << len(keys))
    name = lambda w: "".join("1" if w >> n & 1 else "0" for n in range(len(keys)))
    each = F.array(*(F.struct(F.lit(name(w)).alias("m_given"), *(F.when(F.lit(bool(w >> n & 1)), F.col(f"r_{k}")).alias(f"m_{k}") for n, k in enumerate(keys))) for w in ways))
    offered = there.select("crm_id", F.explode(each).alias("o"))
    full = [(F.substring(F.col("o.m_given"), n + 1, 1) == "0") | F.col(f"o.m_{k}").isNotNull() for n, k in enumerate(keys)]
    offered = offered.where(reduce(and_, full)).select("crm_id", F.col("o.m_given").alias("m_given"), F.xxhash64(*(F.coalesce(F.col(f"o.m_{k}"), F.lit("")) for k in keys)).alias("m_hash"), F.struct(*(F.col(f"o.m_{k}").alias(k) for k in keys)).alias("o_keys"))
    asked = marked.withColumn("m_hash", F.xxhash64(*(F.coalesce(F.col(f"m_{k}"), F.lit("")) for k in keys))).withColumn("a_keys", F.struct(*(F.col(f"m_{k}").alias(k) for k in keys)))
    grouped = offered.groupBy("m_given", "m_hash", "o_keys").agg(F.count(F.lit(1)).alias("n_matches"), F.min("crm_id").alias("matched_id"))
    joined = asked.alias("a").join(grouped.alias("g"), (F.col("a.m_given") == F.col("g.m_given")) & (F.col("a.m_hash") == F.col("g.m_hash")) & F.col("a.a_keys").eqNullSafe(F.col("g.o_keys")), "left")
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), F.coalesce("g.n_matches", F.lit(0)).alias("n_matches"), F.col("g.matched_id").alias("matched_id"))


def resolved_links(rows: DataFrame, targets: DataFrame, row_key: str, target_key: str) -> DataFrame:
    """rows with (target_id, link_rule): null, relation-not-found, relation-ambiguous or relation-deleted."""
    t = targets.groupBy(F.col(target_key).alias("l_key")).agg(F.min(F.when(F.col("crm_deleted_at").isNull(), F.col("crm_id"))).alias("target_id"), F.count_if(F.col("crm_deleted_at").isNull()).alias("l_live"))
    joined = rows.join(t, F.col(row_key) == F.col("l_key"), "left")
    rule = F.when(F.col(row_key).isNull(), F.lit(None)).when(F.col("l_live").isNull(), "relation-not-found").when(F.col("l_live") == 0, "relation-deleted").when(F.col("l_live") > 1, "relation-ambiguous")
    return joined.withColumn("link_rule", rule).withColumn("target_id", F.when(rule.isNull(), F.col("target_id"))).drop("l_key", "l_live")


#: Our own other names of common fields, in their plain form.
OTHER_NAMES = {"email": ["mail", "emailaddress", "emailadresse"], "phone": ["telefon", "telephone", "phonenumber", "mobile", "mobil"], "name": ["company", "firma", "companyname"], "firstname": ["vorname", "givenname"], "lastname": ["nachname", "surname", "familyname"], "city": ["ort", "stadt", "town"], "website": ["url", "homepage", "domain"]}


def plain_name(text: str) -> str:
    """A name's letters and digits in lower case, as headers and fields are compared."""
    return "".join(c for c in text.casefold() if c.isalnum())


def suggested_mapping(headers: list[str], of: ObjectType) -> dict[str, str]:
    """Headers to fields by name, label or another common name; each field once, to the first header that fits best."""
    known: dict[str, str] = {}
    for f in of.fields.values():
        if f.active and not f.inverse:
            for text in (f.name, f.label):
                known.setdefault(plain_name(text), f.name)
    for name, others in OTHER_NAMES.items():
        if name in known or name + "s" in known:
            for other in others:
                known.setdefault(other, known.get(name) or known[name + "s"])
    out: dict[str, str] = {}
    for header in headers:
        field = known.get(plain_name(header))
        if field and field not in out.values():
            out[header] = field
    return out


def suggested_object(headers: list[str], objects: list[ObjectType]) -> str | None:
    """The object that most headers fit, the first of equals; none if no header fits any."""
    scored = [(len(suggested_mapping(headers, of)), of.name) for of in objects if of.active]
    best = max((n for n, _ in scored), default=0)
    return next((name for n, name in scored if n == best), None) if best else None


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, kind, n, n_empty, point): what each text column seems to hold, in one pass."""
    tests = {
        "boolean": lambda t: parse_bool(t).flag.isNotNull(), "date": lambda t: parse_day(t, "DMY").day.isNotNull(), "number": lambda t: parse_number(t).number.isNotNull() | parse_number(t, ",").number.isNotNull(),
        "email": lambda t: t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "url": lambda t: t.rlike(r"(?i)^(https?://|www\.)\S+$"), "money": lambda t: parse_money(t).amountMicros.isNotNull() | parse_money(t, ",").amountMicros.isNotNull(),
    }
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("t")) for c in df.columns))).alias("x")).select("x.column", "x.t")
    counted = long.groupBy("column").agg(F.count("t").alias("n"), F.count_if(F.col("t").isNull()).alias("n_empty"), *(F.count_if(f(F.col("t"))).alias(k) for k, f in tests.items()))
    kind = F.when(F.col("n") == 0, "empty")
    for k in tests:
        kind = kind.when(F.col(k) == F.col("n"), k)
    return counted.select("column", kind.otherwise("text").alias("kind"), "n", "n_empty")


def linked(made: DataFrame, source: DataFrame, column: str, targets: DataFrame, target_key: str, kind: str = "TEXT") -> DataFrame:
    """made (row_no, errors, ...) with `<column>_id`: the record that the cell names, and an error row where there is none,
    several, or only one in the trash. Names are compared in the normal form of `kind`."""
    asked = source.select("row_no", unique_key(kind, F.nullif(F.trim(F.col(column)), F.lit(""))).alias("l_name"))
    known = targets.select("crm_id", "crm_deleted_at", unique_key(kind, F.col(target_key)).alias("l_name"))
    found = resolved_links(asked, known, "l_name", "l_name").select("row_no", F.col("target_id").alias(f"{column}_id"), "link_rule")
    more = F.filter(F.array(error(column, F.col("link_rule"), "no such record")), lambda x: x.isNotNull()).cast(f"array<{ERROR}>")
    return made.join(found, "row_no", "left").withColumn("errors", F.concat("errors", more)).drop("link_rule")


def taken_keys(made: DataFrame, key: Column, records: DataFrame, record_key: Column, matched: str = "matched_id", kind: str = "TEXT") -> DataFrame:
    """made (row_no, matched_id, ...) with `unique_rule`: unique-conflict where another record, live or in the trash, holds the key."""
    held = records.select(unique_key(kind, record_key).alias("u_key"), "crm_id").where("u_key is not null and u_key <> ''").groupBy("u_key").agg(F.min("crm_id").alias("u_low"), F.max("crm_id").alias("u_high"))
    joined = made.withColumn("u_mine", unique_key(kind, key)).join(held, F.col("u_mine") == F.col("u_key"), "left")
    other = F.col("u_key").isNotNull() & ~(F.col(matched).eqNullSafe(F.col("u_low")) & F.col(matched).eqNullSafe(F.col("u_high")))
    return joined.withColumn("unique_rule", F.when(other, "unique-conflict")).drop("u_mine", "u_key", "u_low", "u_high")


def junction(rows: DataFrame, owner: str, target: str) -> DataFrame:
    """(owner, n_links): the distinct links that a junction table adds to each owner."""
    return rows.where(F.col(target).isNotNull()).select(owner, target).distinct().groupBy(owner).agg(F.count(F.lit(1)).alias("n_links"))


def newest_versions(events: DataFrame) -> DataFrame:
    """Of each calendar event (uid) the version with the highest (sequence, modified, start)."""
    row = F.struct(*(F.col(c) for c in events.columns if c != "uid"))
    return events.groupBy("uid").agg(F.max_by(row, F.struct("sequence", "modified", "starts_at")).alias("r")).select("uid", "r.*")


def audience(people: DataFrame, suppressed: DataFrame, blocklist: Column) -> DataFrame:
    """people (person_id, position, email, deleted, subscribed, auto_created) with the first reason that excludes each, or null.

    An address counts as seen from its first person on who isn't excluded before the address test, whatever is decided later.
    """
    key = normalize_email(F.col("email"))
    early = F.when(F.col("deleted"), "person_deleted").when(~F.coalesce("subscribed", F.lit(False)), "not_subscribed").when(key.isNull() | (key == ""), "no_email")
    rows = people.withColumns({"address": key, "early": early})
    first = rows.where("early is null").groupBy("address").agg(F.min("position").alias("first_position"))
    reasons = suppressed.groupBy(normalize_email(F.col("address")).alias("address")).agg(F.max_by("reason", F.when(F.col("reason").isin("BOUNCE", "COMPLAINT"), 2).otherwise(1)).alias("suppression"))


    joined = rows.join(first, "address", "left").join(reasons, "address", "left")
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("position") > F.col("first_position"), "duplicate_address")
        .when(is_blocklisted(F.col("address"), blocklist), "blocklisted")
        .when(F.col("suppression").isNotNull(), F.concat(F.lit("suppressed_"), F.lower("suppression")))
        .when(F.coalesce("auto_created", F.lit(False)), "auto_created")
    )
    return joined.select("person_id", "address", reason.alias("reason"))


def message_reason(unsubscribe: Column, blocked: Column, internal: Column, bulk: Column, group: Column) -> Column:
    """Why a message is skipped, the first that holds, or keep."""
    return F.when(unsubscribe, "unsubscribe_request").when(blocked, "blocklist").when(internal, "internal").when(bulk, "bulk").when(group, "group_sender").otherwise("keep")


def address_reason(own: Column, in_trash: Column, free: Column, blocked: Column, excluded: Column, group: Column, internal: Column) -> Column:
    """Why no person is proposed for an address, the first that holds, or ''."""
    return F.when(own, "own_address").when(in_trash, "person_in_trash").when(free, "free_email").when(blocked, "blocklist").when(excluded, "excluded_handle").when(group, "group_address").when(internal, "internal").otherwise("")


def conflicting(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share a normalised key with a row of another record, by key column: (column, key, n)."""
    each = df.select("crm_id", F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).alias("key")) for k in keys))).alias("x"))
    return each.select("crm_id", "x.*").where("key is not null").groupBy("column", "key").agg(F.countDistinct("crm_id").alias("n")).where("n > 1")


__all__ = ["address_reason", "audience", "coerced", "column_kinds", "conflicting", "file_duplicates", "junction", "matched", "message_reason", "newest_versions", "resolved_links", "unique_key"]
