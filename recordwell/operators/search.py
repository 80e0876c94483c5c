"""Ranked text search over records and pages, JVM-side: words are scored within the row, nothing is exploded.

A text is folded once into its spaced form, each word between spaces of its own; words, starts of words and phrases are then
found by plain substring search, without an array of words.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, normalize_email, url_key, words

#: Weights of a record's parts and of a page's.
RECORD_WEIGHTS = {"title": 10, "EMAILS": 6, "LINKS": 5, "TEXT": 3, "RICH_TEXT": 1}
PAGE_WEIGHTS = {"title": 10, "aliases": 7, "headings": 5, "description": 4, "body": 1}


def query_words(df: DataFrame, text: str) -> list[str]:
    """The words of a query, by the same rule as those of the rows."""
    return list(df.sparkSession.range(1).select(words(F.lit(text)).alias("w")).first().w)


#: A column that isn't deterministic: a filter that names it stays above the projection that makes it.
HERE = "search_row"


def scored(df: DataFrame, tokens: dict[str, Column], score: Column) -> DataFrame:
    """df with a score over 0. Tokens and score are computed once a row: else the filter on the score is pushed down,
    with a copy of the tokens for each of their uses."""
    with_tokens = df.select("*", *(c.alias(k) for k, c in tokens.items()))
    return with_tokens.select("*", score.alias("score"), F.monotonically_increasing_id().alias(HERE)).where((F.col("score") > 0) & (F.col(HERE) >= 0))


def spaced(text: Column) -> Column:
    """The folded words of a text, each with a space before and behind it: ` the  next `."""
    return F.concat(F.lit(" "), F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def _times(text: Column, word: str) -> Column:
    """How often a word occurs in a spaced text, three times at most: the search ends with the third."""
    one = F.lit(f" {word} ")
    first = F.position(one, text)
    second = F.position(one, text, first + len(word) + 2)
    third = F.position(one, text, second + len(word) + 2)
    return F.when(first == 0, 0).when(second == 0, 1).when(third == 0, 2).otherwise(3)


def _starts(text: Column, word: str) -> Column:
    return text.contains(f" {word}")


def _phrase(text: Column, phrase: list[str]) -> Column:
    """Whether the words stand one after the other; the first and the last may be parts of longer ones."""
    return text.contains("  ".join(phrase))


def search_records(df: DataFrame, text: str, parts: list[tuple[str, str, Column]], identities: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows with a `score` over 0. parts: (name, kind, text). Per word: weight times up to three occurrences, else half the
    weight for a word that starts so; the phrase twice the weight; an equal identity 20; all words found 5."""
    phrase_words = query_words(df, text)
    asked = list(dict.fromkeys(phrase_words))
    if not asked:
        raise ValueError("a search needs a letter or digit")
    texts = {f"w_{n}": spaced(c) for n, _, c in parts}
    found = {w: [] for w in asked}
    scores: list[Column] = []
    for name, kind, _ in parts:
        weight, t = RECORD_WEIGHTS[kind], F.col(f"w_{name}")
        for w in asked:
            exact = _starts(t, f"{w} ")
            starts = _starts(t, w) if len(w) >= 2 else exact
            found[w].append(starts)
            scores.append(F.when(exact, _times(t, w) * weight * 10).when(starts, F.lit(weight * 5)).otherwise(0))
        if len(phrase_words) > 1:
            scores.append(F.when(_phrase(t, phrase_words), weight * 20).otherwise(0))
    if identities is not None:
        own = F.array(normalize_email(F.lit(text)), url_key(F.lit(text)))
        scores.append(F.when(F.arrays_overlap(identities, own), 200).otherwise(0))
    total = reduce(add, scores)
    all_found = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, hits) for hits in found.values()))
    tenths = F.when(total > 0, total + F.when(all_found, 50).otherwise(0)).otherwise(0)
    return scored(df, texts, (tenths / 10).cast("decimal(18,2)")).select(*(keep or df.columns), "score")


def search_pages(df: DataFrame, text: str, parts: dict[str, Column], concepts: Column | None = None, status: Column | None = None, matched: list[str] | None = None) -> DataFrame:
    """df with a `score` over 0. parts by PAGE_WEIGHTS' names; 6 for the share of words found, 8 for the phrase in the body,
    12 a matched concept, 3 for an active page, 2 off for a superseded one."""
    phrase_words = query_words(df, text)
    asked = list(dict.fromkeys(phrase_words))
    texts = {f"w_{n}": spaced(c) for n, c in parts.items()}
    counted = reduce(add, (_times(F.col(f"w_{n}"), w) * PAGE_WEIGHTS[n] for n in parts for w in asked))
    hit = reduce(add, (F.when(reduce(lambda a, b: a | b, (_starts(F.col(f"w_{n}"), f"{w} ") for n in parts)), 1).otherwise(0) for w in asked))
    score = (counted + F.lit(6) * hit / len(asked)).cast("decimal(18,4)")
    if "body" in parts:
        score = score + F.when(_phrase(F.col("w_body"), phrase_words), 8).otherwise(0)
    if concepts is not None and matched:
        score = score + F.size(F.array_intersect(concepts, F.array(*map(F.lit, matched)))) * 12
    if status is not None:
        score = score + F.when((score > 0) & (status == "active"), 3).when((score > 0) & status.isin("superseded", "withdrawn"), -2).otherwise(0)
    return scored(df, texts, score.cast("decimal(18,4)")).select(*df.columns, "score")


def relevant_claims(df: DataFrame, text: str, concept_match: Column | None = None, most: int = 8) -> DataFrame:
    """df with `top_claims`, of its column `claims` (array of struct id, text, status): the `most` that share most distinct words
    with the query, by id where equal. A page of a matched concept that has none shows its first active or disputed ones."""
    asked = list(dict.fromkeys(query_words(df, text)))

    def shared(claim: Column) -> Column:
        t = spaced(claim.getField("text"))
        return reduce(add, (F.when(_starts(t, f"{w} "), 1).otherwise(0) for w in asked))

    ranked = F.array_sort(F.filter(F.transform("claims", lambda c: F.struct((-shared(c)).alias("rank"), c.getField("id").alias("id"), c.alias("claim"))), lambda x: x.getField("rank") < 0))
    best = F.transform(F.slice(ranked, 1, most), lambda x: x.getField("claim"))
    open_ones = F.slice(F.filter("claims", lambda c: c.getField("status").isin("active", "disputed")), 1, most)
    return df.withColumn("top_claims", F.when(F.size(best) > 0, best).when(F.coalesce(concept_match, F.lit(False)) if concept_match is not None else F.lit(False), open_ones).otherwise(best))


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, n): how often each value of each field occurs; arrays count each element."""
    lists = {f for f, t in df.dtypes if t.startswith("array")}
    rows = F.array(*(F.struct(F.lit(f).alias("facet"), (F.col(f) if f in lists else F.array(F.col(f).cast("string"))).alias("value")) for f in fields))
    each = df.select(F.explode(rows).alias("r")).select("r.facet", F.explode("r.value").alias("value"))
    return each.where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def snippet(body: Column, asked: list[str], most: int = 200) -> Column:
    """The line that holds most of the words (the first of equals), cut to `most` characters."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    score = lambda line: reduce(add, (F.when(_starts(spaced(line), w), 1).otherwise(0) for w in asked))
    ranked = F.transform(lines, lambda x, k: F.struct(score(x).alias("s"), (-k).alias("k"), x.alias("line")))
    best = F.array_max(ranked)
    line = F.when(best.s > 0, best.line).otherwise("")
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))).otherwise(line)


#: Concepts that one query may match: they are written into its plan.
CONCEPTS = 10_000


def expand(df: DataFrame, text: str, concepts: DataFrame) -> list[str]:
    """All concept ids (id, terms array) of which a term occurs in the query, in order. More than CONCEPTS are refused, never cut."""
    q = F.concat(F.lit(" "), F.array_join(words(F.lit(text)), " "), F.lit(" "))
    hit = F.exists("terms", lambda t: q.contains(F.concat(F.lit(" "), F.array_join(words(t), " "), F.lit(" "))))
    found = sorted(r.id for r in concepts.where(hit).select("id").distinct().limit(CONCEPTS + 1).collect())
    if len(found) > CONCEPTS:
        raise ValueError(f"a query matches more than {CONCEPTS} concepts")
    return found


__all__ = ["expand", "facets", "fold", "query_words", "relevant_claims", "search_pages", "search_records", "snippet"]
