"""Quality classifier: a sparse ensemble of rules, compiled into one Spark column.

Statistics of the text are Spark columns. On a bounded sample of labelled rows, small trees are grown with boosting;
each path from a root becomes a rule, a conjunction of comparisons of statistics. A logistic model with a lasso penalty
over the rules keeps a few of them, and these become one column expression: scoring is part of the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch, crc_mod, row_of

SPACE = r"[\x20\x09-\x0D]"
#: Frequent words of English, German, French and Spanish that nearly any prose holds.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on with as be by at this from or an are you not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur "
    "el que y los se del las un por con no una su para es al lo como"
).split()


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name, all ratios or logarithms; a null or empty text has 0 in each."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    per = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    lines = F.split(text, "\n")
    # possessive, so that a long run of one word needs no deep recursion
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": per(chars, n_words),
        "distinct_words": per(distinct, n_words),
        "root_distinct": per(distinct, F.sqrt(n_words.cast("double"))),
        "repeated_lines": 1 - per(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": per(chars, F.size(lines)),
        "upper": per(count(r"\p{Lu}"), chars),
        "digits": per(count(r"[0-9]"), chars),
        "symbols": per(count(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"), chars),
        "marks": per(count(r"[!?]"), chars),
        "stops": per(count(r"[.,]"), n_words),
        "repeats": per(count(rf"(?<!\S)(\S++)(?:{SPACE}++\1(?!\S))++"), n_words),
        "function_words": per(count(r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(set(FUNCTION_WORDS))) + r")(?![\p{L}\p{N}])"), n_words),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: each (statistic, is it above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(n) > t if above else F.col(n) <= t for n, above, t in self.terms]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole & p
        return whole

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([table[n] > t if above else table[n] <= t for n, above, t in self.terms])


@dataclass
class RuleModel:
    bias: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def column(self) -> Column:
        """The score, over columns named as the statistics."""
        total = F.lit(self.bias)
        for rule, w in self.weights.items():
            total = total + F.when(rule.column(), w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def score(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        return 1 / (1 + np.exp(-(np.full(n, self.bias) + sum((w * r.holds(table) for r, w in self.weights.items()), np.zeros(n)))))


def _grow(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float) -> list[tuple[list, float]]:
    """Paths of one tree that fits the gradients: (terms as (feature, above, threshold), leaf value)."""
    out: list[tuple[list, float]] = []
    todo = [(np.arange(len(g)), [])]
    while todo:
        rows, terms = todo.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if len(terms) < depth:
            for f, edges in enumerate(bins):
                if not len(edges):
                    continue
                gl = np.bincount(codes[rows, f], g[rows], len(edges) + 1).cumsum()[:-1]
                hl = np.bincount(codes[rows, f], h[rows], len(edges) + 1).cumsum()[:-1]
                ok = (hl >= least) & (hs - hl >= least)
                gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            out.append((terms, -gs / (hs + 1)))
            continue
        f, k = best[1], best[2]
        above = codes[rows, f] > k
        todo += [(rows[~above], [*terms, (f, False, bins[f][k])]), (rows[above], [*terms, (f, True, bins[f][k])])]
    return out


def train(table: dict[str, np.ndarray], label: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleModel:
    """Trees, rules and lasso weights from statistics and 0/1 labels. With one class, or no rows, the score is constant."""
    n = len(label)
    rate = (label.sum() + 0.5) / (n + 1)
    if n == 0 or label.min() == label.max():
        return RuleModel(float(math.log(rate / (1 - rate))))
    names = list(table)
    x = np.stack([table[k] for k in names], 1)
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bins)], 1)
    # both classes weigh the same, else the rarer one hardly shapes the trees
    weight = np.where(label == 1, 0.5 / rate, 0.5 / (1 - rate))
    margin, rules = np.zeros(n), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for terms, value in _grow(x, bins, codes, weight * (p - label), weight * p * (1 - p) + 1e-9, depth, 1.0):
            if terms:
                path = Rule(tuple((names[f], above, float(t)) for f, above, t in terms))
                margin[path.holds(table)] += 0.5 * value
                # each path and each of its beginnings is a rule
                for k in range(1, len(terms) + 1):
                    rules[Rule(path.terms[:k])] = None
    rules = list(rules)
    z = np.stack([r.holds(table) for r in rules], 1).astype(float)
    w, bias = np.zeros(len(rules)), math.log(rate / (1 - rate))
    # proximal gradient with momentum; the step is bounded by the largest eigenvalue of z'z / 4n
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / (float(v @ (z.T @ (z @ v))) + n)
    momentum, last, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ momentum + bias)))
        raw = momentum - step * (z.T @ (p - label)) / n
        w = np.sign(raw) * np.maximum(np.abs(raw) - step * penalty, 0)
        bias -= step * float((p - label).mean())
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        momentum, last = w + (old - 1) / t * (w - last), w
    return RuleModel(float(bias), {r: float(a) for r, a in zip(rules, w, strict=True) if a})


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 5, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns quality from rows of ``labels`` (doc_id, quality) whose crc32(doc_id) mod ``folds`` isn't 0, at most
    ``sample`` of them, those with the smallest hash of the id; ids labelled twice count once, with the larger label, and
    null labels don't count; of texts with one id the first in order is learnt from. Only the text's statistics enter a score. A null or empty text is scored by its zero
    statistics; without labels every score is 0.5. An empty table gives an empty result; other columns are ignored.
    ``carry`` adds ``doc``, a struct of the row.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = statistics(F.col("text"))
    own = [row_of(docs)] if carry else []
    held_out = (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out")
    computed = docs.select("doc_id", held_out, *own, *(c.cast("double").alias(f"_{n}") for n, c in stats.items()))
    # through a generator no filter is pushed: statistics are computed once, however often a rule refers to them
    once = F.inline(F.array(F.struct(*(F.col(f"_{n}").alias(n) for n in stats))))
    measured = computed.select("doc_id", "held_out", *(["doc"] if carry else []), once)
    marked = labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    chosen = scratch.store(marked.orderBy(*order).limit(sample))  # at most ``sample`` rows
    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = wanted.select("doc_id", "label", *(c.cast("double").alias(n) for n, c in stats.items())).toPandas().sort_values("doc_id")
    model = train({n: rows[n].to_numpy(float) for n in stats}, rows["label"].to_numpy(float)) if len(rows) else RuleModel(0.0)
    score = model.column()
    return measured.select(
        "doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *(["doc"] if carry else [])
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns, whatever their names. Rows that repeat, or share an id,
    stay or go each by its own text; a null or empty text is judged by its zero statistics; without labels all stay; an
    empty table gives an empty result."""
    return score_quality(docs, labels, carry=True, **options).where("predicted = 1").select("doc.*")
