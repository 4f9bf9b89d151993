"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees propose conjunctive rules (the paths to their nodes), a lasso logistic
regression weighs them and drops most, and the rest is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.words import between_spaces, free_names, whole


def in_rest(chars: str) -> str:
    """SQL for the number of characters of a class in the rest of a text (below)."""
    return f"(length(__r) - length(regexp_replace(__r, '[{chars}]+', '')))"


#: Statistics over the helper columns __t (text), __r (the rest: the text without a-z and blanks, a small part of most
#: texts, where single characters are counted), __s (strings between white space), __w (words: those that are not
#: empty) and __l (lines with a word). White space but blanks, tabs and line ends counts for ``word_length``.
FEATURES: dict[str, str] = {
    "log_words": "ln(1 + size(__w))",
    "word_length": f"(length(__t) - (size(__s) - 1) + {in_rest('\\\\x0B-\\\\x0D')}) / greatest(size(__w), 1)",
    "symbols": f"{in_rest('#*$%&<>@^~')} / greatest(size(__w), 1)",
    "bars": f"{in_rest('|')} / greatest(size(__w), 1)",
    "shouts": f"{in_rest('!')} / greatest(size(__w), 1)",
    "stops": f"{in_rest('.,;:?')} / greatest(size(__w), 1)",
    "digits": f"{in_rest('0123456789')} / greatest(length(__t), 1)",
    "upper": f"{in_rest('\\\\p{Lu}')} / greatest(length(__t), 1)",
    "distinct_words": "size(array_distinct(__w)) / greatest(size(__w), 1)",
    "distinct_lines": "size(array_distinct(__l)) / greatest(size(__l), 1)",
    "line_length": "length(__t) / greatest(size(__l), 1)",
}
#: At most so many labelled rows are used for fitting, those with the lowest key hash.
SAMPLE_ROWS = 20_000


def statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the statistics of each whole text; null text counts as empty."""
    rows = docs.select(*keep, whole(text).alias("__t"))
    rows = rows.withColumn("__r", F.regexp_replace("__t", "[a-z ]+", ""))
    rows = rows.withColumn("__s", between_spaces(F.col("__t"))).withColumn("__w", F.array_remove("__s", ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != "")
    made = {name: F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()}
    of_lines = [name for name, sql in FEATURES.items() if "__l" in sql]
    # lines end a stage of generated code: with what follows, a long score, its method would be too long to be compiled
    rows = rows.select(*keep, "__t", lines.alias("__l"), *[c for name, c in made.items() if name not in of_lines])
    return rows.select(*keep, *[made[name] if name in of_lines else name for name in FEATURES])


# ------------------------------------------------------------------------------------- fitting


@dataclass(frozen=True)
class Rule:
    """Conjunction of (feature, is-above, threshold) tests."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.tests:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, names: Sequence[str]) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            c = F.col(names[f])
            out = out & ((c > F.lit(t)) if above else (c <= F.lit(t)))
        return out


@dataclass
class RuleModel:
    names: list[str]
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(self.names), F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))


def grow_rules(
    x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.3
) -> list[Rule]:
    """Rules of all nodes of gradient-boosted trees with histogram splits."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            k = codes[rows, f]
            lg = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
            lh = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            gain[(n < 5) | (len(rows) - n < 5)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            deeper = []
            for rows, tests in nodes:
                _, f, at = split(rows, g, h) if level < depth else (0, None, None)
                if f is None:
                    z[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                t = float(cuts[f][at])
                below = codes[rows, f] <= at
                for side, above in ((rows[below], False), (rows[~below], True)):
                    path = tuple(sorted({*tests, (f, above, t)}))
                    rules[Rule(path)] = None
                    deeper.append((side, path))
            nodes = deeper
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v = np.r_[w, b]
    last, t = v.copy(), 1.0
    a = np.c_[r, np.ones(n)]
    probe = np.ones(m + 1)
    for _ in range(20):
        probe = a.T @ (a @ probe)
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 4 * n / norm
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - last)
        last, t = new, t_new
    return last[:-1], float(last[-1])


def fit(x: np.ndarray, y: np.ndarray, names: Sequence[str], penalty: float = 2e-4) -> RuleModel:
    """Rules from trees, weights by lasso; a constant model where no rule separates two labels."""
    if not len(y) or y.min() == y.max():
        return RuleModel(list(names), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rules = grow_rules(x, y)
    if not rules:
        return RuleModel(list(names), float(np.log(y.mean() / (1 - y.mean()))))
    support = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    _, first = np.unique(support, axis=1, return_index=True)
    first = np.sort(first)
    rules, support = [rules[i] for i in first], support[:, first]
    w, b = lasso(support, y, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(list(names), b, [rules[i] for i in used], w[used].tolist())


def remainder(key: str, mod: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def fit_on_labels(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
    label: str = "quality", folds: int = 5, sample: int = SAMPLE_ROWS,
) -> RuleModel:
    """Fits on at most ``sample`` labelled rows outside the held-out fold.

    Those with the lowest key hash are taken; they are few enough to be broadcast, and statistics are
    computed for their texts only. Rows without label or key are left out; a key with several labels
    counts with each. Of documents that share a key one counts, that with the lowest statistics, so that
    the bound holds for repeated keys too.
    """
    names = list(FEATURES)
    known = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
    known = known.where(F.col("__y").isin(0, 1) & (remainder("__k", folds) != 0))
    known = known.orderBy(F.xxhash64(F.col("__k").cast("string")), "__k", "__y").limit(sample)
    rows = docs.select(F.col(key).alias("__j"), F.col(text).alias("__text"))
    rows = rows.join(F.broadcast(known), F.col("__j") == F.col("__k"))
    one = F.min(F.struct(*names)).alias("one")
    data = statistics(rows, "__text", ("__j", "__y")).groupBy("__j", "__y").agg(one).select("__j", "__y", "one.*")
    data = data.toPandas().sort_values(["__j", "__y"])
    return fit(data[names].to_numpy(float), data["__y"].to_numpy(float), names)


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3
) -> DataFrame:
    """``key, held_out, score, predicted`` of every document.

    The model is fitted first, then one pass without a shuffle takes the statistics of each whole
    text and evaluates the compiled rules. Labels are only learned outside the held-out fold (crc32 of the key as text, modulo 5, is 0). Null and empty texts have statistics
    like any other and get a score; null keys are never held out; repeated rows score alike; without
    labels every score is 0.5; an empty table gives an empty table.
    """
    score = fit_on_labels(docs, labels, text, key).score()
    stats = statistics(docs, text, (key,))
    held = F.coalesce(remainder(key, 5) == 0, F.lit(False))
    rows = stats.select(F.col(key), held.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that the classifier accepts, scored by the compiled rules in one pass."""
    model = fit_on_labels(docs, labels, text, key)
    (row,) = free_names(docs, "row")
    rows = statistics(docs.withColumn(row, F.struct("*")), text, (row,))
    return rows.where(model.score() >= 0.3).select(f"{row}.*")
