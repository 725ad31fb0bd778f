"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine t or more are at most eps = sqrt(2 - 2 t) apart, and their projections on
any orthonormal axes no farther. The axes are leading principal ones of a bounded sample; they
decide how much is skipped, never what is found. Vectors are ordered by label and by the cells, eps
wide, of their leading projections. Runs of that order are blocks, runs of blocks are tiles, each
with the bounding box of its projections. Two tiles of a label whose boxes are farther apart than
eps hold no link and never meet. Tiles that may are joined recursively: blocks, then halves of
halves, skipping what is provably distant, down to products of small matrices in double precision.
A tile's vectors are copied once per tile that it meets, and a count and one link per vector and
pair of tiles leave a task.

Defined cases: null labels, null vectors, zero vectors and vectors with null, NaN or infinite parts
link with nothing; vectors of different lengths don't link; a null vec_id links with nothing; rows
that repeat a vec_id share its links and are not links of each other; an empty table gives nothing;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm.groups import whole_groups
from slackline.operators.components import connected_components
from slackline.plans.scratch import Scratch

COSINE = 0.93
#: Leading axes of the grid order; axes of the bounding boxes; rows of a block and of a leaf; bytes of a block and of a tile.
GRID, BOX, BLOCK, LEAF, BLOCK_BYTES, TILE_BYTES = 4, 16, 1024, 128, 2 << 20, 16 << 20
#: Rows and bytes of the sample that the axes come from.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20


def _unit(batch: pd.DataFrame) -> np.ndarray:
    x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, v of the rows that may link with anything."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long"), "label", F.size(v).alias("dim"), v.alias("v"))


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, at most BOX orthonormal axes as columns, leading first, from a sample of at most SAMPLE rows and SAMPLE_BYTES.

    Lengths that the sample has few rows of get the plain leading coordinates.
    """
    most = rows.agg(F.max("dim")).first()[0] or 1
    least = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * most)))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "v").limit(least).toPandas()
    found = {}
    for dim, part in got.groupby("dim"):
        x = _unit(part)
        if len(x) >= 4 * BOX:
            x = x - x.mean(axis=0)
            found[int(dim)] = np.linalg.svd(x, full_matrices=False)[2][:BOX].T.copy()
    return found


def _projected(y: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    held = axes.get(y.shape[1])
    return y[:, :BOX] if held is None else y @ held


def in_grid_order(rows: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """vec_id, label, dim, y: unit vectors, range-partitioned and sorted by grid order."""
    held = rows.sparkSession.sparkContext.broadcast(axes)

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("dim"):
                y = _unit(part)
                cells = np.floor(_projected(y, held.value)[:, :GRID] / eps).astype(np.int32)
                cells = np.pad(cells, ((0, 0), (0, GRID - cells.shape[1])))
                out = part[["vec_id", "label", "dim"]].copy()
                for k in range(GRID):
                    out[f"c{k}"] = cells[:, k]
                out["y"] = [r.tobytes() for r in y]
                yield out

    kind = rows.schema["label"].dataType.simpleString()
    cells = [f"c{k}" for k in range(GRID)]
    turned = rows.mapInPandas(turn, f"vec_id long, label {kind}, dim int, {', '.join(c + ' int' for c in cells)}, y binary")
    order = ["label", "dim", *cells, "vec_id"]
    return turned.repartitionByRange(*order).sortWithinPartitions(*order)


def cut_blocks(ordered: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """tile, block, label, dim, low, high (box), ids, ys: runs of the order, of one label and length."""
    kind = ordered.schema["label"].dataType.simpleString()
    held = ordered.sparkSession.sparkContext.broadcast(axes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n = tile = TaskContext.get().partitionId() << 32
        filled, now = 0, None
        for batch in batches:
            key = batch["label"].astype(str) + " " + batch["dim"].astype(str)
            out, size = [], 0
            for run in (key != key.shift()).cumsum().to_frame("r").groupby("r").indices.values():
                label, dim = batch["label"].iloc[run[0]], int(batch["dim"].iloc[run[0]])
                step = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim)))
                for lo in range(0, len(run), step):
                    part = batch.iloc[run[lo : lo + step]]
                    ys = b"".join(part["y"])
                    if now != (label, dim) or filled + len(ys) > TILE_BYTES:
                        tile, filled, now = n, 0, (label, dim)
                    p = _projected(np.frombuffer(ys, dtype=np.float64).reshape(len(part), -1), held.value)
                    out.append((tile, n, label, dim, p.min(axis=0), p.max(axis=0), part["vec_id"].to_numpy().tobytes(), ys))
                    n, filled, size = n + 1, filled + len(ys), size + len(ys)
                    if size > TILE_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    names = ["tile", "block", "label", "dim", "low", "high", "ids", "ys"]
    return ordered.select("vec_id", "label", "dim", "y").mapInPandas(cut, f"tile long, block long, label {kind}, dim int, low array<double>, high array<double>, ids binary, ys binary")


def near_tiles(blocks: DataFrame, eps: float) -> DataFrame:
    """a, b (a <= b): tiles of a label and length whose boxes are within eps of each other."""
    corner = lambda f, c: F.array(*(f(F.get(c, F.lit(k))) for k in range(BOX)))
    box = blocks.groupBy("tile", "label", "dim").agg(corner(F.min, "low").alias("low"), corner(F.max, "high").alias("high"))
    cell = lambda c: F.floor(c / eps).cast("long")
    left = box.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))))
    right = box.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0] - eps), cell(F.col("high")[0] + eps))))
    right = right.select("label", "dim", "cell", F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    met = left.withColumnRenamed("tile", "a").join(right, ["label", "dim", "cell"]).where("a <= b")
    gap = F.aggregate(  # axes beyond a short vector's length are null and far from nothing
        F.arrays_zip("low", "high", "low_b", "high_b"), F.lit(0.0),
        lambda s, d: s + F.pow(F.greatest(d["low"] - d["high_b"], d["low_b"] - d["high"], F.lit(0.0)), 2),
    )
    return met.where(gap <= eps * eps).select("a", "b").distinct()


def sequence_join(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, cosine: float, eps: float, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y, with projections p and q, of cosine at least ``cosine``; if same, each once."""
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(a: int, b: int, c: int, d: int) -> None:
        if same and d <= a:
            return
        gap = np.maximum(0, np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            return
        if max(b - a, d - c) <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                out.append((i, j))
            return
        m, n = (a + b + 1) // 2, (c + d + 1) // 2
        for lo, hi in ((a, m), (m, b)):
            for lo2, hi2 in ((c, n), (n, d)):
                if lo < hi and lo2 < hi2:
                    meet(lo, hi, lo2, hi2)

    if len(x) and len(y):
        meet(0, len(x), 0, len(y))
    return out


def reach(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each reaches over the edges a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_links(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """vec_id, links, root: partial counts by pair of tiles, and a vector that links connect it to."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    rows = usable(vectors)
    axes = principal_axes(rows)
    blocks = scratch.save(cut_blocks(in_grid_order(rows, axes, eps), axes), "blocks")
    pairs = scratch.save(near_tiles(blocks, eps), "pairs")
    both = pairs.select(F.struct("a", "b").alias("g"), F.explode(F.expr("if(a = b, array(struct(a AS tile, 0 AS side)), array(struct(a AS tile, 0 AS side), struct(b AS tile, 1 AS side)))")).alias("s"))
    dealt = both.select(F.xxhash64("g").alias("g"), "g.a", "g.b", "s.tile", "s.side").join(blocks.select("tile", "block", "dim", "ids", "ys"), "tile").select("g", "a", "b", "side", "block", "dim", "ids", "ys")
    held = rows.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "a", "b"):
            for _, part in frame.groupby(["a", "b"], sort=False):
                found = _tile_links(part, held.value, cosine, eps)
                if found is not None:
                    yield found

    dealt = dealt.repartition("g").sortWithinPartitions("g", "a", "b", "side", "block")
    return scratch.save(dealt.mapInPandas(run, "vec_id long, links long, root long"), "links")


def _tile_links(rows: pd.DataFrame, axes: dict[int, np.ndarray], cosine: float, eps: float) -> pd.DataFrame | None:
    """vec_id, links, root of the vectors of two tiles, or of one with itself, that link with any."""
    y = [np.frombuffer(v, dtype=np.float64).reshape(-1, dim) for v, dim in zip(rows["ys"], rows["dim"], strict=True)]
    p = [_projected(v, axes) for v in y]
    ids = np.concatenate([np.frombuffer(v, dtype=np.int64) for v in rows["ids"]])
    first = np.cumsum([0, *map(len, y)])
    side = rows["side"].to_numpy()
    links, ends = np.zeros(len(ids), dtype=np.int64), ([], [])
    for s in range(len(y)):
        for t in range(s, len(y)):
            if side[s] == side[t] and (side == 1).any():  # within one tile only when it meets itself
                continue
            got = sequence_join(y[s], y[t], p[s], p[t], cosine, eps, s == t)
            if not got:
                continue
            i, j = np.concatenate([a for a, _ in got]) + first[s], np.concatenate([b for _, b in got]) + first[t]
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            # Of this pair of blocks, only links that connect what they connect are kept.
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            ends[0].append(used)
            ends[1].append(used[reach(len(used), place[: len(i)], place[len(i) :])])
    if not ends[0]:
        return None
    root = reach(len(ids), np.concatenate(ends[0]), np.concatenate(ends[1]))
    linked = np.flatnonzero(links)
    return pd.DataFrame({"vec_id": ids[linked], "links": links[linked], "root": ids[root[linked]]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors(vec_id, embedding, label)``."""
    scratch = Scratch(vectors.sparkSession, "ego_join")
    links = embedding_links(vectors, scratch, cosine)
    counts = scratch.save(links.groupBy("vec_id").agg(F.sum("links").alias("n")), "counts")
    groups = connected_components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch)
    least = scratch.save(groups.groupBy("component").agg(F.min("id").alias("least")), "least")
    of = groups.join(least, "component").join(counts.withColumnRenamed("vec_id", "id"), "id")
    of = scratch.save(of.select(F.col("id").alias("vec_id"), "n", "least"), "of")
    out = vectors.select(F.col("vec_id").cast("long")).join(of, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
