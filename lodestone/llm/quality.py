"""Quality classifier as a sparse rule ensemble.

Shallow trees are grown by gradient boosting on text statistics; every path from a root to a node is a rule, the
conjunction of its thresholds; a lasso logistic regression over the rules keeps few of them; and the kept rules are
compiled into one Spark column expression, a sigmoid of a weighted sum of conditions. Statistics are shares and means,
so texts of any length are alike; neither labels, language, source nor id is among them.

Training takes at most TRAIN_ROWS labelled ids, those of least hash, to the driver as numbers (a documented bound, one
row an id); everything else runs on the executors. Rows whose crc32(doc_id as text) mod 5 is 0 are never trained on.

Defined cases: a null or empty text has all statistics 0 and gets a score; labels of a null or repeated doc_id are
ignored and counted once (the highest label); without both labels among the training rows every score is the mean
label, 0.5 if there is none; repeated rows give a row each; extra columns are kept by `filter_good`; an empty table
gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_fold, passing, settle, text_of, words_of

TRAIN_ROWS = 20_000
TREES, DEPTH, CUTS, LEAST = 12, 3, 24, 20
PENALTY, STEPS = 2e-3, 400
THRESHOLD = 0.3


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """The features by name, all double."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.array_join(words, "")), F.lit(1)).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "log_words": F.log10(n),
        "mean_word": chars / n,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "symbols": F.regexp_count(text, F.lit(r"[#*$%&<>{}\[\]\\^~=]")) / n,
        "bars": F.regexp_count(text, F.lit(r"\|")) / n,
        "bangs": F.regexp_count(text, F.lit("[!?]")) / n,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "stops": F.regexp_count(text, F.lit(r"[.]")) / n,
        "distinct": F.size(F.array_distinct(words)) / n,
        "stutter": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / n,
        "same_lines": 1 - F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n / n_lines,
    }


NAMES = ("log_words", "mean_word", "upper", "symbols", "bars", "bangs", "digits", "stops", "distinct", "stutter", "same_lines", "line_words")


@dataclass(frozen=True)
class Ensemble:
    """rules: conjunctions of (feature number, "le" or "gt", threshold)."""

    bias: float
    weights: tuple[float, ...]
    rules: tuple[tuple[tuple[int, str, float], ...], ...]

    def score(self, x: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for w, rule in zip(self.weights, self.rules):
            test = F.lit(True)
            for j, side, cut in rule:
                test = test & (x[NAMES[j]] <= cut if side == "le" else x[NAMES[j]] > cut)
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(X: np.ndarray, r: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set) -> list:
    """Paths of a regression tree on the residuals r: (path, rows) of its leaves; every node's path goes into rules."""
    if path:
        rules.add(path)
    best = None
    if depth and len(rows) >= 2 * LEAST:
        y = r[rows]
        for j in range(X.shape[1]):
            v = X[rows, j]
            for c in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])):
                low = v <= c
                k = int(low.sum())
                if min(k, len(rows) - k) < LEAST:
                    continue
                s, t = y[low].sum(), y.sum()
                gain = s * s / k + (t - s) ** 2 / (len(rows) - k) - t * t / len(rows)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, float(c), low)
    if best is None or best[0] < 1e-9:
        return [(path, rows)]
    _, j, c, low = best
    return grow(X, r, rows[low], depth - 1, (*path, (j, "le", c)), rules) + grow(X, r, rows[~low], depth - 1, (*path, (j, "gt", c)), rules)


def fires(X: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(X), bool)
    for j, side, c in rule:
        out &= X[:, j] <= c if side == "le" else X[:, j] > c
    return out


def lasso(Z: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, m = Z.shape
    A = np.hstack([np.ones((n, 1)), Z])
    step = 4.0 / (np.linalg.eigvalsh(A.T @ A / n)[-1] + 1e-12)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(STEPS):
        g = A.T @ (1 / (1 + np.exp(-np.clip(A @ z, -30, 30))) - y) / n
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_arrays(X: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble for statistics X (columns NAMES) and labels y."""
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or mean in (0.0, 1.0):
        p = min(max(mean, 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(p / (1 - p))), (), ())
    f, rules = np.full(len(y), np.log(mean / (1 - mean))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        for path, rows in grow(X, y - p, np.arange(len(y)), DEPTH, (), rules):
            f[rows] += 0.5 * (y - p)[rows].sum() / max((p * (1 - p))[rows].sum(), 1e-6)
    ordered = sorted(rules)
    if not ordered:
        return Ensemble(float(np.log(mean / (1 - mean))), (), ())
    bias, w = lasso(np.stack([fires(X, r) for r in ordered], 1).astype(float), y)
    kept = [i for i in range(len(ordered)) if abs(w[i]) > 1e-6]
    return Ensemble(bias, tuple(float(w[i]) for i in kept), tuple(ordered[i] for i in kept))


def with_statistics(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """docs with its statistics under prefix, and no other new column."""
    names = docs.columns
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text_of().alias("_t")).select("_row", "_t", words_of(F.col("_t")).alias("_w"))
    stats = statistics(F.col("_t"), F.col("_w"))
    return df.select(*[F.col("_row")[c].alias(c) for c in names], *[c.cast("double").alias(prefix + k) for k, c in stats.items()])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, settled: texts are read once."""
    return settle(with_statistics(docs.select("doc_id", "text")).drop("text"))


def known(labels: DataFrame) -> DataFrame:
    """doc_id and _y of the labels outside fold 0, one row for each id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
    return rows.groupBy("doc_id").agg(F.max("quality").cast("double").alias("_y"))


def training_ids(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and _y of the labelled ids of docs outside fold 0 that have the least hashes, at most rows, settled. They
    are counted, and only those under a hash that about 1.2 * rows of them pass are sorted, so no task and not the driver
    sees more."""
    ids = settle(known(labels).join(docs.select("doc_id"), "doc_id", "left_semi"))
    share = min(1.0, 1.2 * rows / max(ids.count(), 1))
    low = F.xxhash64("doc_id").cast("double") < F.lit(share * 2.0**64 - 2.0**63)
    return settle((ids if share == 1.0 else ids.where(low)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def fit(stats: DataFrame, ids: DataFrame) -> Ensemble:
    """The ensemble trained on ids (training_ids()) with their statistics in stats; of rows of one id the least counts."""
    cols = [f"_q_{n}" for n in NAMES]
    train = stats.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct(*cols)).alias("x")).select("_y", "x.*", F.xxhash64("doc_id").alias("_h"))
    got = np.array(sorted(tuple(r)[::-1] for r in train.collect()), float).reshape(-1, len(cols) + 2)[:, 1:]
    return fit_arrays(got[:, -2::-1], got[:, -1])


def prefixed(prefix: str = "_q_") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in NAMES}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each document."""
    with passing(docs.sparkSession) as keep:
        stats = keep(measured(docs))
        model = fit(stats, training_ids(stats, labels))
    df = stats.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), model.score(prefixed()).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filter_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, all columns kept as they are. A plain filter on the score would
    be planned over the texts, statistic by statistic; an array of the row or of nothing is not."""
    with passing(docs.sparkSession):
        ids = training_ids(docs, labels)
        model = fit(with_statistics(docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")), ids)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    df = with_statistics(docs.select(row.alias("_whole"), F.col("text")))
    one = F.array(F.struct("_whole", model.score(prefixed()).alias("score")))
    kept = df.select(F.inline(F.filter(one, lambda x: x["score"] >= threshold)))
    return kept.select(*[F.col("_whole")[c].alias(c) for c in names])
