"""Quality of a text by a sparse ensemble of rules over its statistics.

Small boosted trees are grown on the statistics of labelled texts; each node's path is a rule,
a conjunction of thresholds. A lasso logistic regression weighs the rules, most of which
drop out; the rest become one Spark column expression, so scoring needs no Python.

Rules are learned from a bounded sample: SAMPLE labelled texts are expected, chosen by a
hash of the id, out of the rows with a remainder other than 0.

Defined results: a null text counts as empty; an empty text has statistics of 0 and is scored like
any other; without labels every score is 0.5. Null ids and null labels aren't learned from;
repeated labels count as often as they come; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_out, unit_hash

SAMPLE = 12_000
#: Rules that may carry a weight, at most.
RULES = 40

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether it is at most, threshold)

MARKS = "!|#$%&*"
#: Our own list of words that hold sentences together, in four languages: prose has many, lists and junk few.
STOP_WORDS = "the of and to in is that it for was with as on be at by der die das und in den von zu mit sich des auf für ist im le la les de et des en un une que qui dans pour el los las y que en un una por con para".split()
ROW = "q_row"


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and the statistics in columns q_*."""
    return _statistics(docs, keep).select("keep.*", *NAMES)


def _statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, as a struct of that name, and the statistics in columns q_*: names of docs meet none of ours."""
    text, n = F.col("q_text"), F.greatest(F.length("q_text"), F.lit(1))
    words, many = F.col("q_words"), F.greatest(F.size("q_words"), F.lit(1))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("keep"), F.coalesce(F.col("text"), F.lit("")).alias("q_text")).withColumn("q_words", F.split("q_text", r"\s+"))
    share = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c)))) / n
    again = F.size(F.filter(words, lambda w, k: (k > 0) & (w == F.get(words, k - 1))))
    lines = F.filter(F.split("q_text", "\n"), lambda x: F.trim(x) != "")
    made = {
        "q_digit": (F.length(text) - F.length(F.regexp_replace(text, "[0-9]+", ""))) / n,
        "q_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))) / many,
        "q_line_again": (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
        "q_length": F.log1p(F.length(text)),
        "q_upper": (F.length(text) - F.length(F.regexp_replace(text, "[A-ZÀ-Þ]+", ""))) / n,
        "q_again": again / many,
        "q_distinct": F.log1p(F.size(F.array_distinct(words))) / F.log1p(many),
        "q_word": F.length(text) / many,
        "q_line": (F.length(text) - F.length(F.replace(text, F.lit("\n")))) / many,
    } | {f"q_mark{k}": share(c) for k, c in enumerate(MARKS)}
    # ROW isn't deterministic: a filter that names it stays above the statistics, which are so computed once a row.
    return base.select("keep", F.monotonically_increasing_id().alias(ROW), *(c.cast("double").alias(k) for k, c in made.items()))


NAMES = ["q_digit", "q_stop", "q_line_again", "q_length", "q_upper", "q_again", "q_distinct", "q_word", "q_line", *(f"q_mark{k}" for k in range(len(MARKS)))]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, ((x[:, NAMES.index(f)] <= t) == low for f, low, t in rule))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 20) -> list[Rule]:
    """The paths of boosted trees, each of them once."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49), method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin <= b means x <= cuts[b]
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)

        def split(rows: np.ndarray, path: Rule, left: int, slope=slope, curve=curve) -> None:
            g, h = slope[rows].sum(), curve[rows].sum()
            best = (1e-6, None, None)
            for f, c in enumerate(cuts if left and len(rows) >= 2 * least else []):
                if len(c):
                    a = np.cumsum(np.bincount(bins[rows, f], slope[rows], len(c) + 1))[:-1]
                    b = np.cumsum(np.bincount(bins[rows, f], curve[rows], len(c) + 1))[:-1]
                    m = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))[:-1]
                    gain = np.where((m >= least) & (len(rows) - m >= least), a**2 / (b + 1) + (g - a) ** 2 / (h - b + 1) - g**2 / (h + 1), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] is None:
                margin[rows] += rate * g / (h + 1)
                return
            _, f, k = best
            for low in (True, False):
                longer = (*path, (NAMES[f], low, float(cuts[f][k])))
                rules.setdefault(tuple(sorted(set(longer))), None)
                split(rows[(bins[rows, f] <= k) == low], longer, left - 1)

        split(np.arange(len(y)), (), depth)
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """L1 logistic weights of 0/1 columns and the bias, by accelerated proximal steps over the distinct rows."""
    rows, at, count = np.unique(r, axis=0, return_inverse=True, return_counts=True)
    z, total = np.c_[rows, np.ones(len(rows))], len(y)
    ones = np.bincount(at.ravel(), y, len(rows))
    step = 4 * total / max(np.linalg.norm((z * count[:, None]).T @ z, 2), 1e-9)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        slope = z.T @ (count / (1 + np.exp(-(z @ v))) - ones) / total
        new = v - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * strength, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


class RuleEnsemble:
    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def score(self) -> Column:
        """Over the columns of statistics()."""
        one = lambda rule: reduce(and_, ((F.col(f) <= t) if low else (F.col(f) > t) for f, low, t in rule))
        total = reduce(lambda a, b: a + b, (F.when(one(r), F.lit(w)).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)), F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Learn labels.quality of the documents that aren't held out."""
    usable = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(unit_hash(F.col("doc_id"), 9) < share)  # bounded by `sample`, so it may be broadcast
    rows = _statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "quality"])
    got = np.array(sorted(tuple(r) for r in rows.select("keep.quality", *NAMES).collect()), float).reshape(-1, 1 + len(NAMES))
    y, x = got[:, 0], got[:, 1:]
    if not len(y) or y.min() == y.max():
        return RuleEnsemble([], [], 0.0 if not len(y) else 4.0 * (2 * y[0] - 1))
    rules = grow(x, y)
    if not rules:  # too few labels to split
        return RuleEnsemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float)
    strength = 3e-4
    while True:
        w, bias = lasso(r, y, strength)
        if (np.abs(w) > 1e-6).sum() <= RULES:
            break
        strength *= 1.5
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[k] for k in used], [float(w[k]) for k in used], bias)


def scored(docs: DataFrame, model: RuleEnsemble, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row a document."""
    found = _statistics(docs, ["doc_id"]).select("keep.doc_id", held_out(F.col("keep.doc_id")).alias("held_out"), model.score().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))


def good(docs: DataFrame, model: RuleEnsemble, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that score at least `least`."""
    return _statistics(docs, docs.columns).where((model.score() >= least) & (F.col(ROW) >= 0)).select("keep.*")
