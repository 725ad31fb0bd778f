"""Quality by histogram gradient-boosted trees over document statistics.

Statistics come from the whole text (bytes, words, lines). Trees are complete and of one depth, so
a model is three arrays and a text walks them by 2 * node + 1 + (value > threshold), all texts of a
batch at once in numpy. The fit uses at most SAMPLE labelled rows.

Defined cases: null text counts as empty; empty texts get the score of their all-zero statistics;
a null doc_id is not held out; repeated rows are scored each; an empty table gives nothing; without
labelled rows every score is 0.5, with one label only that label's; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm.labelled import held_out, labelled_sample
from slackline.llm.names import free

#: Most labelled rows that a fit uses.
SAMPLE = 20_000
FOLDS, FOLD, THRESHOLD = 3, 1, 0.5

STATISTICS = (
    "log_bytes log_words word_length unique_words repeated_next top_word pairs_unique upper digits non_ascii stops commas "
    "exclaims pipes symbols quotes brackets newlines per_line repeated_lines short_words long_words entropy packed shouted ends"
).split()
_SYMBOLS, _BRACKETS = b"#$%&*@^~_=+\\/<>", b"()[]{}"


def statistics(text: str) -> list[float]:
    """The numbers named by STATISTICS; zeros for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    some = counts[counts > 0] / n
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = text.split("\n")
    sizes = np.fromiter(map(len, words), dtype=np.int32, count=w)
    return [
        math.log1p(n), math.log1p(w), float(sizes.mean()), len(seen) / w, sum(map(eq, words, words[1:])) / w, max(seen.values()) / w,
        len(set(zip(words, words[1:], strict=False))) / w, counts[65:91].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n, counts[46] / w, counts[44] / w,
        counts[33] / w, counts[124] / w, counts[list(_SYMBOLS)].sum() / w, (counts[34] + counts[39]) / w, counts[list(_BRACKETS)].sum() / w, (len(lines) - 1) / w, w / len(lines), 1 - len(set(lines)) / len(lines),
        float((sizes <= 2).mean()), float((sizes >= 12).mean()), float(-(some * np.log2(some)).sum()), len(zlib.compress(raw, 1)) / n, sum(map(str.isupper, words)) / w, sum(map(str.endswith, words, [(".", "!", "?")] * w)) / w,
    ]


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.12, bins: int = 48, least: float = 4.0, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Boosting on the logistic loss; splits are sought in histograms of at most ``bins`` quantile bins."""
    rows, columns = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if rows else np.zeros(0) for j in range(columns)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.int64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if rows else 0.5
    base, inner = math.log(share / (1 - share)), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), dtype=np.int32), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    margin = np.full(rows, base)
    for t in range(trees if rows else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain, at, cut = np.full(width, 1e-6), np.zeros(width, dtype=np.int32), np.full(width, np.inf)
            for j, edge in enumerate(edges):
                if not len(edge):
                    continue
                m = len(edge) + 1
                key = local * m + binned[:, j]
                hist_g, hist_h = (np.bincount(key, v, width * m).reshape(width, m).cumsum(1) for v in (g, h))
                all_g, all_h = hist_g[:, -1:], hist_h[:, -1:]
                left_g, left_h = hist_g[:, :-1], hist_h[:, :-1]
                won = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                won[(left_h < least / 4) | (all_h - left_h < least / 4)] = -1
                k = won.argmax(1)
                best = won[np.arange(width), k]
                more = best > gain
                gain[more], at[more], cut[more] = best[more], j, edge[k[more]]
            feature[t, first : first + width], threshold[t, first : first + width] = at, cut
            node = 2 * node + 1 + (x[np.arange(rows), at[local]] > cut[local])
        local = node - inner
        leaf[t] = -rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        margin += leaf[t][local]
    return {"feature": feature, "threshold": threshold, "leaf": leaf, "base": np.array(base)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    margin, rows = np.full(len(x), float(model["base"])), np.arange(len(x))
    inner = model["feature"].shape[1]
    for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        while len(x) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        margin += leaf[node - inner]
    return 1 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [statistics(t) for t in batch["text"]]})

    rows = labelled_sample(docs, labels, "quality", FOLDS, FOLD, sample).select("text", "label")
    got = rows.mapInPandas(measure, "label int, x array<double>").toPandas()  # at most `sample` rows
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(STATISTICS))
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # the same model whatever order rows come in
    return fit_trees(x[order], got["label"].to_numpy(dtype=float)[order])


def score(docs: DataFrame, model: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` columns and a new one, 0 to 1."""
    if free(docs.columns, name) != [name]:
        raise ValueError(f"there is a column {name} already")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([statistics(t or "") for t in batch], dtype=float).reshape(len(batch), len(STATISTICS))
            yield pd.Series(predict(held.value, x))

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels) if model is None else model
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
