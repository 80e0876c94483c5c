"""Numbers, money and booleans out of text, with the rule that a bad cell breaks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"
#: Words for true and false in tables.
TRUE_WORDS = "true wahr ja yes y j x 1 ✓ ✔".split()
FALSE_WORDS = "false falsch nein no n 0 ✗ ✘".split()
#: Currency signs and their codes, and signs that several currencies share.
CURRENCY_SIGNS = {"€": "EUR", "EURO": "EUR", "£": "GBP", "$": "USD", "US$": "USD", "¥": "JPY", "₹": "INR", "₽": "RUB", "₺": "TRY", "₩": "KRW", "₪": "ILS", "zł": "PLN", "Kč": "CZK", "Fr.": "CHF", "SFr.": "CHF", "Ft": "HUF", "R$": "BRL", "CA$": "CAD", "C$": "CAD", "A$": "AUD"}
SHARED_SIGNS = "kr kr. Kr Kr.".split()

_some_sign = "|".join(re.escape(s) for s in sorted([*CURRENCY_SIGNS, *SHARED_SIGNS], key=len, reverse=True))


def parse_number(text: Column, point: str = ".") -> Column:
    """A struct (number, rule): grouped digits, signs before or after, brackets for negatives, exponents. point: the decimal mark.

    Plain expressions only, no higher-order function: they stay within generated code, which computes repeated parts once.
    """
    groups = (".'" if point == "," else ",'") + " \u00a0\u202f"
    mark = re.escape(point)
    shape = rf"(?:(?:\d+|\d{{1,3}}(?:[{groups}]\d{{3}})+)(?:{mark}\d+)?(?:[eE][+-]?\d+)?|{mark}\d+)"
    t = F.trim(text)
    bare = F.translate(F.regexp_replace(t, r"^[(+\-−]\s*|\s*[)\-−]$", ""), point + groups, ".")
    number = F.when(t.rlike(rf"^(?:[(+\-−]\s*)?{shape}(?:\s*[)\-−])?$"), bare.try_cast(NUMBER))
    negative = (t.startswith("(") & t.endswith(")")) | t.startswith("-") | t.startswith("−") | t.endswith("-") | t.endswith("−")
    signed = F.when(negative, -number).otherwise(number)  # one and the same expression in both parts: computed once
    return F.struct(signed.alias("number"), F.when(signed.isNull() & (t != ""), "number").alias("rule"))


def decimal_point(texts: Column) -> Column:
    """As an aggregate over a column: which mark is the decimal one, '.' or ',', or null where the texts don't tell."""
    comma = F.count_if(texts.rlike(r"\.\d{3},\d+$") | texts.rlike(r"^\D*\d+,\d{1,2}\D*$"))
    dot = F.count_if(texts.rlike(r",\d{3}\.\d+$") | texts.rlike(r"^\D*\d+\.\d{1,2}\D*$"))
    return F.when((comma > 0) & (dot == 0), ",").when((dot > 0) & (comma == 0), ".")


#: A leading code or sign, the number up to its last digit, a trailing code or sign.
_money = rf"^(?:([A-Z]{{3}})(?=[^A-Za-z])|({_some_sign})(?=.))?\s*(.*[0-9)\-−])\s*(?:(?<=[^A-Za-z])([A-Z]{{3}})|({_some_sign}))?$"
_cut = "\u0001"


def parse_money(text: Column, point: str = ".", default_code: str | None = None) -> Column:
    """A struct (amountMicros, currencyCode, rule): an ISO code or a sign before or after the number.

    A sign that several currencies share, such as kr, is an error, as are amounts finer than a millionth. The
    text is taken apart by one pattern, within generated code.
    """
    t = F.trim(text)
    known = F.create_map(*(F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair))
    parts = F.split(F.regexp_replace(t, _money, _cut.join(f"${k}" for k in range(1, 6))), _cut)
    code_before, sign_before, amount, code_after, sign_after = (F.get(parts, F.lit(k)) for k in range(5))
    code, sign = F.concat(code_before, code_after), F.concat(sign_before, sign_after)
    sound = (F.length(code) <= 3) & ((code == "") | (sign == "")) & ((sign_before == "") | (sign_after == "")) & ~sign.isin(SHARED_SIGNS)
    n = parse_number(amount, point).getField("number")
    # The number comes first in the condition: what is always evaluated is computed once for all of its uses.
    micros = F.when((n == F.round(n, 6)) & sound, (n * 1_000_000).try_cast("long"))
    found = F.coalesce(F.nullif(code, F.lit("")), F.try_element_at(known, sign), F.lit(default_code))
    return F.struct(micros.alias("amountMicros"), F.when(sound, found).alias("currencyCode"), F.when(micros.isNull() & (t != ""), "currency").alias("rule"))


def parse_bool(text: Column) -> Column:
    """A struct (flag, rule)."""
    t = F.lower(F.trim(text))
    flag = F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)
    return F.struct(flag.alias("flag"), F.when(flag.isNull() & (t != ""), "boolean").alias("rule"))


def parse_list(text: Column) -> Column:
    """A JSON array or a text cut at commas, semicolons or bars; blanks and repeats go."""
    t = F.trim(text)
    split = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, r"\s*[,;|]\s*"))
    return F.array_distinct(F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != ""))


def size_text(bytes_: Column) -> Column:
    """A byte count for people."""
    steps = [("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)]
    out = F.concat(bytes_.cast("string"), F.lit(" B"))
    for unit, size in reversed(steps):
        out = F.when(bytes_ >= size, F.concat(F.format_number(F.round(bytes_.cast("decimal(30,4)") / size, 1), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def micros(amount: Column) -> Column:
    """Millionths of an amount with up to six places; null if it has more."""
    exact = amount.cast(NUMBER)
    return F.when(exact == F.round(exact, 6), (exact * 1_000_000).try_cast("long"))
