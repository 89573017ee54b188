"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are boosted on a bounded sample of labelled rows; every path from
a root becomes a conjunctive rule; lasso logistic regression keeps few of them;
and what it keeps is compiled into one Spark column expression, so scoring is a
projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD_START, removed, stash

#: The most labelled rows that a fit takes to the driver (each a few hundred bytes).
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text, by name; null counts as empty. None reads anything but the text."""
    text = F.coalesce(text, F.lit(""))
    # Frequent things are counted by their single characters, rare ones as matches.
    places = lambda pattern: removed(text, pattern).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    lines = F.split(text, "\n")
    words, chars, n_lines = places(WORD_START), F.char_length(text).cast("double"), F.size(lines).cast("double")
    share = lambda part, of: part / F.greatest(of, F.lit(1.0))
    return {
        "chars": chars,
        "words": words,
        "word_length": share(chars, words),
        "upper": share(places(r"\p{Lu}"), chars),
        "digits": share(places(r"[0-9]"), chars),
        "stops": share(places(r"[.,;:](?=\s|$)"), words),
        "exclamations": share(places(r"!"), words),
        "symbols": share(places(r"(?<![#$%&*+<=>@\\^_`{|}~])[#$%&*+<=>@\\^_`{|}~]"), words),
        "bare_symbols": share(count(r"(?<=\s)[^\s\p{L}\p{N}]+(?=\s)"), words),
        "links": share(count(r"://"), words),
        "line_words": share(words, n_lines),
        "repeated_lines": share(n_lines - F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "doubled_words": share(count(r"(?<!\S)(\S++)\s\1(?!\S)"), words),
        "mixed_words": share(count(r"\p{Ll}\p{Lu}"), words),
        "capital_starts": share(places(r"(?<!\S)\p{Lu}"), words),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, cut): above says > cut, else <= cut."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, of: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, ((of[n] > F.lit(c)) if above else (of[n] <= F.lit(c)) for n, above, c in self.tests))

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        parts = [(x[:, names.index(n)] > c) if above else (x[:, names.index(n)] <= c) for n, above, c in self.tests]
        return np.logical_and.reduce(parts)


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Between neighbouring values, at quantiles of each statistic's distinct values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        out.append(middle if len(middle) <= bins else np.unique(np.quantile(middle, np.linspace(0, 1, bins))))
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, bins: int = 48, least: int = 10, rate: float = 0.3, seed: int = 5) -> list[Rule]:
    """The distinct paths of boosted trees, each grown on half the rows and half the statistics."""
    rng, cuts = np.random.default_rng(seed), _cuts(x, bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def grow(rows, slope, allowed, path, level):
        total, n = slope[rows].sum(), len(rows)
        best = (1e-9, None, None)
        for f in allowed if level < depth else ():
            if not len(cuts[f]):
                continue
            sums = np.cumsum(np.bincount(binned[rows, f], slope[rows], len(cuts[f]) + 1))[:-1]
            counts = np.cumsum(np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1))[:-1]
            ok = (counts >= least) & (n - counts >= least)
            gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
            if gain.max(initial=0) > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if path:
            rules.setdefault(Rule(tuple(sorted(path))), None)
        if best[1] is None:
            return [(rows_of(path), total / n)]
        _, f, k = best
        low = binned[rows, f] <= k
        cut = float(cuts[f][k])
        return grow(rows[low], slope, allowed, [*path, (names[f], False, cut)], level + 1) + grow(rows[~low], slope, allowed, [*path, (names[f], True, cut)], level + 1)

    rows_of = lambda path: Rule(tuple(path)).holds(x, names) if path else np.ones(len(x), bool)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        allowed = rng.permutation(len(names))[: max(2, (len(names) + 1) // 2)]
        for inside, value in grow(rows, y - p, allowed, [], 0):
            margin[inside] += rate * 4 * value
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 5e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, m = z.shape
    centre, spread = z.mean(axis=0, dtype=float), z.std(axis=0, dtype=float)
    spread[spread == 0] = 1.0
    z = (z - centre.astype(np.float32)) / spread.astype(np.float32)  # the largest array that the driver holds
    step = 4.0 / (np.linalg.eigvalsh((z.T @ z).astype(float))[-1] / n + 1.0) if m else 1.0
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        slope = 1 / (1 + np.exp(-(z @ v.astype(z.dtype) + c))) - y
        new = v - step * (z.T @ slope.astype(z.dtype)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b, new_t = c - step * slope.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    w = w / spread
    return w, b - float(centre @ w)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, of: dict[str, Column]) -> Column:
        """The chance of label 1, from columns of the statistics."""
        terms = (F.when(r.column(of), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def held_out(id_col: str) -> Column:
    """Rows that no fit may use: crc32 of the id as text leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **how) -> RuleModel:
    """Fit on rows of `docs` with a label 0 or 1, held-out rows left out.

    At most sample_rows rows are taken, those with the least hash of their id. A
    row that has several labels counts once for each. Without any row, or with
    one label only, the model has no rules and a smoothed mean as its score.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("_y")).where("_y in (0, 1)").where(~held_out("id"))
    # First the labels, of which sample_rows are enough; then the texts of these alone.
    chosen = marked.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id", "_y").limit(sample_rows)
    chosen = stash(chosen, "labels")
    stats = statistics(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most sample_rows ids
    rows = rows.select("id", "_y", F.xxhash64("text").alias("_text"), *[c.alias(n) for n, c in stats.items()])
    names = list(stats)
    rows = rows.orderBy(F.xxhash64("id"), "id", "_y", "_text").limit(sample_rows).select("_y", *names).toPandas()
    y, x = rows["_y"].to_numpy(float), rows[names].to_numpy(float)
    del rows
    if not len(y) or y.min() == y.max():
        mean = (y.sum() + 1) / (len(y) + 2)
        return RuleModel((), (), float(np.log(mean / (1 - mean))))
    rules = tree_rules(x, y, names, **how)
    # Rules that hold for the same rows say the same: the first of them stands for all.
    holds = {}
    for rule in rules:
        holds.setdefault(np.packbits(rule.holds(x, names)).tobytes(), rule)
    z = np.stack([np.unpackbits(np.frombuffer(bits, np.uint8), count=len(y)) for bits in holds], axis=1) if holds else np.zeros((len(y), 0), np.uint8)
    weights, intercept = lasso_logistic(z, y)
    kept = [(rule, float(w)) for rule, w in zip(holds.values(), weights) if abs(w) > 1e-6]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(intercept))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """id, held_out, score, predicted for every row of `docs`.

    Scores lie between 0 and 1, higher where label 1 is likelier; null and empty
    texts are scored as texts without words. predicted is 1 from a score of 0.5
    on. Repeated rows get equal scores. No rows give no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **how)
    stats = statistics(F.col(text_col))
    scored = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in stats.items()]).select("id", model.score({n: F.col(n) for n in stats}).alias("score"))
    scored = stash(scored, "scores")  # a filter on a score must not move below the statistics
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """`docs` without the rows that the classifier rejects (score below 0.5)."""
    model = fit(docs, labels, id_col, text_col, label_col, **how)
    stats = statistics(F.col(text_col))
    # The row travels as one column, so no name of its own can clash. A rejected row explodes to none: a
    # filter would move below the statistics and compute them anew in each rule.
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in stats.items()])
    good = model.score({n: F.col(n) for n in stats}) >= 0.5
    rows = rows.select("row", F.explode(F.when(good, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
