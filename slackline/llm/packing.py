"""Best-fit packing of token pieces, after reduction by dominance.

What has to be packed is only a histogram: how many pieces there are of each length, 1 to
``capacity``. It has at most ``capacity`` rows whatever the corpus, so the driver packs it whole.
Largest length first, Martello and Toth's reduction fixes at once, for as many bins as there are
pieces, the sets of up to three that provably dominate every other set holding that length (see
``dominating``); lengths it can't decide stay in the instance, partners for all that follow, and
passes go on until one fixes nothing. The remainder is packed best-fit decreasing, in groups of
like bins; if best-fit alone, without the reduction, takes fewer bins, its packing is used. Pieces
then take their places by rank within their length; ranks come from counts by (length, bucket), so
a length that a third of all pieces share is never ranked in one task.

Defined cases: null text is empty; an empty text is one piece, the closing id; repeated rows are
packed as often as they come; an empty table gives nothing; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm import memo
from slackline.plans.scratch import Scratch

CAPACITY, END = 4096, 1
#: Bytes that each half of a worker's table of word ids may take, if not said otherwise: time for memory.
CACHE_BYTES = 96 << 20
#: Marks that make one run when they end a word, and that begin no token of letters.
STOPS = ".,!?;:#$%&*"


class WordIds(memo.Halves):
    """Token ids of words, as little-endian 32-bit bytes, learnt as they are asked for.

    Sound for tokenizers whose tokens cross neither a space nor the end of a run of letters, and
    that ignore case: a text's ids are its words' ids, a word's ids those of its letters in lower
    case and of the marks behind them. Runs of Latin letters go to the tokenizer's model,
    the rest through the whole tokenizer. Latin-1 texts are lowered at once, unless an added token is named in them.
    One table serves all tasks of a worker.
    """

    tables: dict[tuple[str, int], WordIds] = {}

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.names = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Latin letters from U+0080, as the model reads them; composed, so normal form C leaves them alone.
        self.letters = {k: split(chr(k))[0][0] for k in range(0x80, 0x130) if chr(k).isalpha()}

    @classmethod
    def of(cls, path: str, most: int) -> WordIds:
        if (path, most) not in cls.tables:
            cls.tables.clear()
            cls.tables[path, most] = cls(path, most)
        return cls.tables[path, most]

    def learnt(self, word: str) -> bytes:
        ascii = word.isascii()
        if word.isalpha() and (ascii or max(word) < "\u0130"):
            low = word.lower()
            if low != word:
                return self[low]
            return array("I", [t.id for t in self.model.tokenize(word if ascii else word.translate(self.letters))]).tobytes()
        core = word.rstrip(STOPS)
        if core != word and core[-1:].isalpha() and core[-1] < "\u0130":  # later letters may end in a mark, which joins the stop
            return self[core] + self[word[len(core) :]]
        return array("I", self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def of_text(self, text: str) -> bytes:
        low = text.lower() if text.isascii() or self._latin(text) else text  # at once, where letters lower one by one
        if any(name in low for name in self.names):  # found by the tokenizer as they are written
            low = text
        return b"".join(map(self.__getitem__, low.replace("\n", " ").split(" ")))

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            return bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False


memo.register("packing", WordIds.tables.clear)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids (bytes, little-endian 32-bit): each text's ids and ``end``, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        memo.claim("packing")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, tail, step = WordIds.of(tokenizer, cache_bytes), np.asarray([end], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for lo in range(0, len(batch), 512):
                rows = []
                for doc, text in zip(batch["doc_id"].iloc[lo : lo + 512], batch["text"].iloc[lo : lo + 512], strict=True):
                    whole = ids.of_text(text) + tail
                    doc = None if pd.isna(doc) else int(doc)
                    rows += [(doc, k, k * capacity, min(step, len(whole) - at) // 4, whole[at : at + step]) for k, at in enumerate(range(0, len(whole), step))]
                made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids binary")


class _Sizes:
    """Lengths that still have pieces, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def give(self, size: int) -> None:
        if size not in self.n:
            bisect.insort(self.order, size)
        self.n[size] = self.n.get(size, 0) + 1

    def at_most(self, room: int) -> int:
        k = bisect.bisect_right(self.order, room)
        return self.order[k - 1] if k else 0

    def least(self, n: int, above: int = 0) -> list[int]:
        """The n smallest pieces longer than ``above``; fewer if there are no more."""
        out: list[int] = []
        for k in range(bisect.bisect_right(self.order, above), len(self.order)):
            out += [self.order[k]] * min(n - len(out), self.n[self.order[k]])
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum of two pieces that is at most room; 0 if none."""
        best, hi = 0, len(self.order) - 1
        for lo, size in enumerate(self.order):
            while hi >= lo and (self.order[hi] + size > room or hi == lo and self.n[size] < 2):
                hi -= 1
            if hi < lo:
                break
            best = max(best, size + self.order[hi])
        return best


def dominating(left: _Sizes, size: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside a piece of ``size`` so that no other choice from ``left`` can be better; None if that isn't known.

    A set dominates another if the other's pieces can be dealt into groups, each no longer than a
    piece of the set. Nothing, if nothing fits. The longest piece that fits, if it fills the bin, if
    no two pieces fit, or if no three do and no two are longer together. It and the longest beside
    it, if no three pieces fit and no two fit that are both longer than the second.
    """
    room = capacity - size
    left.take(size, 1)
    try:
        first, low = left.at_most(room), left.least(3)
        if not first:
            return ()
        if first == room or len(low) < 2 or low[0] + low[1] > room:
            return (first,)
        if len(low) == 3 and sum(low) <= room:
            return None
        if left.best_pair(room) <= first:
            return (first,)
        left.take(first, 1)
        second = left.at_most(room - first)
        left.give(first)
        longer = left.least(2, second)
        return (first, second) if second and (len(longer) < 2 or sum(longer) > room) else None
    finally:
        left.give(size)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Fixed bins as (how many, [(length, pieces of it in each)]), and the counts that are left.

    A choice that dominates does so while its pieces last, as others only grow fewer: it is fixed
    for as many bins as they fill.
    """
    left, fixed, found = _Sizes(counts), [], True
    while found:
        found, size = False, left.at_most(capacity)
        while size:
            beside = dominating(left, size, capacity)
            if beside is None:
                size = left.at_most(size - 1)
                continue
            each = Counter((size, *beside))
            bins = min(left.n[k] // v for k, v in each.items())
            for k, v in each.items():
                left.take(k, bins * v)
            fixed.append((bins, list(each.items())))
            found, size = True, left.at_most(size)
    return fixed, left.n


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as reduce_by_dominance gives them. Like bins are filled together."""
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, group: tuple[int, list[tuple[int, int]]]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(group)

    def fill(room: int, group: tuple[int, list[tuple[int, int]]], size: int, n: int) -> int:
        """Puts up to n pieces into the group's bins, each as full as it gets; what is left of n."""
        bins, held = group
        each = room // size
        full = min(bins, n // each)
        if full:
            put(room - each * size, (full, [*held, (size, each)]))
        n -= full * each
        if full < bins and n:
            put(room - n * size, (1, [*held, (size, n)]))
            full, n = full + 1, 0
        if full < bins:
            put(room, (bins - full, held))
        return n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                n = fill(capacity, (-(-n // each), []), size, n)
                break
            room = rooms[k]
            group = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            n = fill(room, group, size, n)
    return [(bins, held) for room in by_room for bins, held in by_room[room] if held]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places by rank: pieces of ``length`` ranked first_rank .. last_rank - 1 go ``each`` to a bin, from bin ``sequence`` on, at ``offset``."""
    fixed, left = reduce_by_dominance(counts, capacity)
    packings = [*fixed, *best_fit_decreasing(left, capacity)], best_fit_decreasing(counts, capacity)
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, held in min(packings, key=lambda p: sum(bins for bins, _ in p)):
        offset = 0
        for length, each in held:
            rows.append((length, rank[length], rank[length] + bins * each, each, sequence, offset))
            rank[length] += bins * each
            offset += each * length
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "first_rank", "last_rank", "each", "sequence", "offset"]).astype("int64").sort_values(["length", "first_rank"], ignore_index=True)


def place(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with sequence_id and offset; offsets are gapless from 0."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.save(pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    counts = scratch.save(pieces.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = pack_histogram(histogram, capacity)
    first = {int(k): v for k, v in table.groupby("length").indices.items()}
    held = spark.sparkContext.broadcast((first, {c: table[c].to_numpy() for c in table.columns}))
    counts.createOrReplaceTempView("__pack_counts")
    base = spark.sql("SELECT length, __bucket, coalesce(sum(n) OVER (PARTITION BY length ORDER BY __bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __base FROM __pack_counts")
    base = scratch.save(base, "base")
    spark.catalog.dropTempView("__pack_counts")
    pieces.createOrReplaceTempView("__pack_pieces")
    ranked = spark.sql("SELECT *, row_number() OVER (PARTITION BY length, __bucket ORDER BY doc_id, piece) - 1 AS __at FROM __pack_pieces")
    spark.catalog.dropTempView("__pack_pieces")
    ranked = ranked.join(base, ["length", "__bucket"]).withColumn("__rank", F.col("__base") + F.col("__at")).drop("__base", "__at", "__bucket")

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, t = held.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            row = np.empty(len(batch), dtype=np.int64)
            for size in np.unique(length):
                at, rows = np.flatnonzero(length == size), first[int(size)]
                row[at] = rows[np.searchsorted(t["first_rank"][rows], rank[at], "right") - 1]
            within = rank - t["first_rank"][row]
            batch["sequence_id"] = t["sequence"][row] + within // t["each"][row]
            batch["offset"] = t["offset"][row] + within % t["each"][row] * length
            yield batch.drop(columns="__rank")

    schema = [f for f in ranked.schema.fields if f.name != "__rank"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(seat, out)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (bytes), doc_ids by place."""
    placed = place(token_pieces(docs, tokenizer, capacity, end), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most `capacity` pieces
    whole = placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", "length", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def pack(docs: DataFrame, tokenizer: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = token_pieces(docs, tokenizer, cache_bytes=cache_bytes).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
