"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts with equal shingle sets are one class, handled once. Classes whose MinHash agrees in a band
are candidates; inside a band's bucket pairs are compared STEP hash values at a time, and a pair
goes as soon as the posterior probability that its similarity reaches the threshold, given the
agreements so far and a flat prior, is below TOLERANCE. What survives joins classes into clusters;
every pair of a cluster is then verified exactly on its shingle sets, pruned ones as well, as
products of 0/1 matrices over blocks of classes. Buckets and clusters beyond a block are dealt out
as pairs of blocks, so no task ever holds a whole large group, and only counts and one link per row
leave a task, never all pairs. Sets are copied once per block of their cluster; a cluster has at
most SPREAD blocks until they are full (BLOCK_ROWS classes or BLOCK_BYTES of shingles).

At J = 0.8 a band of 4 agrees with probability 0.41, one of the 28 bands with 1 - 4e-7; the pruning
adds about as much again.

Defined cases: words are runs between white space; a text of fewer than five words is one shingle;
null and empty texts have none and link with nothing, each its own class; rows with null doc_id
link like any others, and a class whose rows all lack an id has a null class_id; rows that repeat a
doc_id are rows each; an empty table gives nothing; extra columns are ignored, and carried by
``keep_one`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.llm import memo
from slackline.llm.groups import starts, whole_groups
from slackline.llm.names import free
from slackline.operators.components import connected_components
from slackline.plans.scratch import Scratch

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 28, 4, 16, 1e-7
BUCKET_BLOCK, BLOCK = 2048, 256
SPREAD, BLOCK_ROWS, BLOCK_BYTES = 16, 2048, 16 << 20


class _WordHash(memo.Halves):
    def learnt(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_words = _WordHash(16 << 20)
memo.register("ngram_join", _words.forget)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of every run of ``n`` words."""
    words = text.split()
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(20)
    return (draw.randint(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1), draw.randint(0, 2**31, BANDS * ROWS).astype(np.uint32))


_A, _B = _seeds()


def min_hash(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(least, (x[lo : lo + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
    return key.astype(np.int64)


def least_agreements(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements of ``n`` 8-bit values with which a pair may still reach the threshold.

    Values agree with probability p = J + (1 - J) / 256. With a flat prior the posterior of
    p >= p0 after m of n agreements is P(Bin(n + 1, p0) <= m).
    """
    p0, total = threshold + (1 - threshold) / 256, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * p0**m * (1 - p0) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_NEED = [(n, least_agreements(n)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def survivors(sigs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[k], b[k]) of rows of ``sigs`` are not pruned, compared step by step."""
    live, got = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for n, need in _NEED:
        part = slice(n - STEP, n)
        got[live] += (sigs[a[live], part] == sigs[b[live], part]).sum(axis=1, dtype=np.int32)
        live = live[got[live] >= need]
        if not len(live):
            break
    return live


def bucket_links(sigs: np.ndarray, edges: np.ndarray, small: int = 16) -> list[tuple[int, int]]:
    """Links between rows of the same bucket (rows edges[k] .. edges[k + 1] - 1) that connect all that survives."""
    out: list[tuple[int, int]] = []
    size = np.diff(edges)
    of = np.repeat(np.arange(len(size)), size)
    few = size[of] <= small
    for d in range(1, min(small, int(size.max(initial=0)))):
        a = np.flatnonzero((of[:-d] == of[d:]) & few[:-d])
        for lo in range(0, len(a), 200_000):
            part = a[lo : lo + 200_000]
            part = part[survivors(sigs, part, part + d)]
            out += zip(part.tolist(), (part + d).tolist(), strict=True)
    for k in np.flatnonzero(size > small):
        rest = np.arange(edges[k], edges[k + 1])
        while len(rest):  # breadth first: whatever a row links to is taken out and asked next
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                row = todo.pop()
                hit = survivors(sigs, np.full(len(rest), row), rest)
                out += ((row, int(r)) for r in rest[hit])
                todo += rest[hit].tolist()
                rest = np.delete(rest, hit)
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    size = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    number = np.cumsum(often > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = 4096
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), min(width, int(number[-1]) + 1 - lo)), dtype=np.float32)
        part[rows[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    np.fill_diagonal(out, size)
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric 0/1 matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _text_key() -> F.Column:
    """What a row without an id is found by; null for the others."""
    return F.when(F.col("doc_id").isNull(), F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo.claim("ngram_join")
        for batch in batches:
            ids, sigs, keys, sizes = [], [], [], []
            for text in batch["text"]:
                found = shingles(text)
                sizes.append(len(found))
                if len(found):
                    least = min_hash(found)
                    ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sigs.append(least.astype(np.uint8).tobytes())
                    keys.append(band_keys(least))
                else:
                    ids.append(None), sigs.append(None), keys.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "set_id": ids, "size": sizes, "sig": sigs, "bands": keys})

    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), _text_key().alias("text_key"))
    return docs.mapInPandas(run, "doc_id long, text_key binary, set_id binary, size long, sig binary, bands array<long>")


def _blocks(df: DataFrame, row: str, key: str, n: F.Column) -> DataFrame:
    """Rows of a group of ``n`` blocks dealt out to pairs of blocks; ``g`` names group and pair."""
    n = F.greatest(F.lit(1), n.cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64(row), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    df = df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return df.withColumn("g", F.xxhash64(key, "lo", "hi")).withColumn("single", n == 1)


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links a, b between classes that survive in some bucket."""
    keyed = classes.select("set_id", F.explode("bands").alias("key"))
    several = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    rows = keyed.join(several, "key").join(classes.select("set_id", "sig"), "set_id")
    rows = _blocks(rows, "set_id", "key", F.ceil(F.col("n") / BUCKET_BLOCK)).select("g", "key", "set_id", "sig")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, "g", "key"):
            sigs = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(len(rows), BANDS * ROWS)
            ids = rows["set_id"].to_numpy()
            pairs = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in bucket_links(sigs, starts(rows["g"].to_numpy(), rows["key"].to_numpy()))}
            yield pd.DataFrame(sorted(pairs), columns=["a", "b"])

    links = rows.repartition("g").sortWithinPartitions("g", "key").mapInPandas(run, "a binary, b binary")
    return scratch.save(links.distinct(), "links")


def _verified(docs: DataFrame, clusters: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id, links (weighted by copies), root, single: of every class that has a verified link."""
    wanted = scratch.save(clusters.join(classes.select(F.col("set_id").alias("id"), "rep", "rep_key", "copies", "size"), "id").withColumnRenamed("id", "set_id"), "clustered")
    n, full = F.count("*"), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)
    sizes = wanted.groupBy("component").agg(F.greatest(F.least(F.ceil(n / BLOCK), F.lit(SPREAD)), F.ceil(n / BLOCK_ROWS), full).alias("n"))
    wanted = scratch.save(wanted.join(sizes, "component").select("rep", "rep_key", "set_id", "component", "n", "copies"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), _text_key().alias("rep_key"), F.coalesce("text", F.lit("")).alias("text"))
    unnamed = texts.where("rep is null").groupBy("rep_key").agg(F.first("text").alias("text"))
    out = "set_id", "component", "n", "copies", "text"
    texts = texts.join(wanted.drop("rep_key").hint("merge"), "rep").select(*out).unionByName(unnamed.join(wanted.where("rep is null").drop("rep"), "rep_key").select(*out))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo.claim("ngram_join")
        told: set[bytes] = set()  # a doc_id may have many rows, of the same set or of others
        for batch in batches:
            sets = []
            for text, set_id in zip(batch["text"], batch["set_id"], strict=True):
                found = None if set_id in told else shingles(text).tobytes()
                if found is not None and hashlib.blake2b(found, digest_size=16).digest() != set_id:
                    found = None
                elif found is not None:
                    told.add(set_id)
                sets.append(found)
            out = batch.drop(columns="text")
            out["sh"] = sets
            yield out[out["sh"].notna()]

    sets = texts.mapInPandas(cut, "set_id binary, component binary, n long, copies long, sh binary")
    dealt = _blocks(sets, "set_id", "component", F.col("n")).select("g", "component", "set_id", "copies", "sh", (F.col("own") == F.col("lo")).alias("low"), (F.col("lo") == F.col("hi")).alias("inner"), "single")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, "g", "component"):
            out = []
            edges = starts(rows["g"].to_numpy(), rows["component"].to_numpy())
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = rows.iloc[lo:hi].drop_duplicates("set_id")  # told by several tasks
                if len(part) < 2:
                    continue
                sets = [np.frombuffer(s, dtype=np.uint64) for s in part["sh"]]
                size = np.array([len(s) for s in sets], dtype=float)
                both = overlaps(sets)
                linked = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if not part["inner"].iloc[0]:
                    low = part["low"].to_numpy()
                    linked &= low[:, None] != low[None, :]
                count, root, ids = linked @ part["copies"].to_numpy(), local_roots(linked), part["set_id"].to_numpy()
                out += [(ids[k], int(count[k]), ids[root[k]], bool(part["single"].iloc[0])) for k in np.flatnonzero(count)]
            yield pd.DataFrame(out, columns=["set_id", "links", "root", "single"])

    found = dealt.repartition("g").sortWithinPartitions("g", "component").mapInPandas(run, "set_id binary, links long, root binary, single boolean")
    return scratch.save(found, "verified")


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, set_id, root, class_id, n_links: one row per row of ``docs``; set_id and root are null where a text has no shingles."""
    scratch = Scratch(docs.sparkSession, "ngram_join")
    rows = scratch.save(_signatures(docs), "rows")
    first = F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("rep_key"), F.count("*").alias("copies"), *first)
    classes = scratch.save(classes, "classes")
    links = _candidates(classes, scratch)
    clusters = connected_components(links, scratch, "cand")
    verified = _verified(docs, clusters, classes, scratch)
    per_class = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    across = connected_components(verified.where("not single").select(F.col("set_id").alias("a"), F.col("root").alias("b")), scratch, "true")
    roots = verified.where("single").select("set_id", "root").unionByName(across.select(F.col("id").alias("set_id"), F.col("component").alias("root")))
    joined = classes.select("set_id", "rep", "copies").join(per_class, "set_id", "left").join(roots, "set_id", "left")
    joined = scratch.save(joined.withColumn("root", F.coalesce("root", "set_id")), "joined")
    least = scratch.save(joined.groupBy("root").agg(F.min("rep").alias("class_id")), "least")
    found = joined.join(least, "root").select("set_id", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = scratch.save(found, "found")
    alone = F.col("set_id").isNull()
    out = rows.where(~alone).select("doc_id", "set_id").join(found, "set_id").select("doc_id", "set_id", "root", "class_id", "n_links")
    none = F.lit(None).cast("binary")
    return out.unionByName(rows.where(alone).select("doc_id", none.alias("set_id"), none.alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, kept: one row per row of ``docs``.

    n_links counts the other rows of Jaccard similarity 0.8 or more over shingles of five words;
    class_id is the least doc_id that links reach; kept marks the rows of that id.
    """
    return _classed(docs).select("doc_id", "class_id", "n_links").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _set_id(texts: pd.Series) -> pd.Series:
    memo.claim("ngram_join")
    found = (shingles(t) for t in texts)
    return pd.Series([hashlib.blake2b(f.tobytes(), digest_size=16).digest() if len(f) else None for f in found], dtype=object)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of its least doc_id, or any if none has an id. Rows without shingles stay.

    Where a doc_id has several rows, or a row has none, each goes or stays by its own text's class.
    """
    scratch = Scratch(docs.sparkSession, "keep_one")
    rows = scratch.save(_classed(docs).select("doc_id", "set_id", "root", "class_id"), "rows")
    per_id = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("class_id")).alias("off"))
    per_id = scratch.save(per_id.where("n > 1 or off"), "per_id")
    first = docs.where("doc_id is not null").join(per_id.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = per_id.where("n > 1").select("doc_id")
    if again.isEmpty() and rows.where("doc_id is null").isEmpty():
        return first
    set_id, of_id, of_set = free(docs.columns, "set_id", "of_id", "of_set")
    some = docs.where("doc_id is null").unionByName(docs.join(again, "doc_id", "left_semi").select(docs.columns))
    some = scratch.save(some.withColumn(set_id, F.pandas_udf(_set_id, "binary")(F.coalesce("text", F.lit("")))), "some")
    stay = rows.where("root is not null and doc_id <=> class_id").groupBy("root").agg(F.min(F.struct("doc_id", "set_id")).alias("r")).select(F.col("r.doc_id").alias(of_id), F.col("r.set_id").alias(of_set))
    held = some.join(stay, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(set_id) == F.col(of_set))).dropDuplicates([of_id, of_set])
    return first.unionByName(held.select(docs.columns)).unionByName(some.where(F.col(set_id).isNull()).select(docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
