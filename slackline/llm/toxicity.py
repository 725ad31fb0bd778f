"""Toxicity by a weighted finite-state grammar over clauses.

Two layers of transducers. The lower one reads the letters of a word through a trie and writes a
class (insult, threat, target, negation, report, break) and a weight. The upper one reads the
classes of a clause; it is the product of five small machines (is something negated, is the clause
reported speech, is somebody addressed, did an insult just pass, is there a threat and who is its
target), composed once into a single table whose arcs carry a factor for the word's weight and an
amount of their own. A threat waits for its target till the clause ends, with the negation and the
reported speech that it was met in. A text is judged by its clauses' totals, never by words alone;
a logistic curve turns them into a score.

Insult words come from a fixed list and from labelled rows: words and word beginnings whose log
odds stay high after subtracting their uncertainty. The fit uses at most SAMPLE labelled rows, and
every feature that occurs LEAST times in them. LEAST, SETTINGS and the features of the curve were
chosen by ``cross_validate`` inside rows that are not held out; which of SETTINGS serves, a fit finds
out on those of its rows that gave no words, as few labels and many want different ones.

Defined cases: null and empty texts match no clause and get the lowest score; a null doc_id is not
held out; repeated rows are scored each; an empty table gives nothing; without labelled rows of both
kinds the fixed list and a fixed curve serve; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm import memo
from slackline.llm.labelled import held_out, labelled_sample
from slackline.llm.names import free
from slackline.plans.scratch import Scratch

#: Most labelled rows that a fit uses.
SAMPLE = 16_000
#: Rows of label 1 that a learned feature is in.
LEAST = 3
#: The least lower bound of a learned feature's log odds, and how many deviations below the odds that bound lies.
SETTINGS = ((1.6, 1.6), (2.0, 1.6), (2.6, 1.6), (2.6, 1.3))
FOLDS, FOLD, THRESHOLD = 4, 2, 0.3
#: Distinct symbol sequences that a worker keeps from text to text.
SEQUENCES = 50_000

ORDINARY, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb pathetic worthless loser losers scum trash clown disgusting imbecile fool vermin filth".split(),
    THREAT: (
        "kill kills killed killing murder murders murdered murdering destroy destroys destroyed destroying hurt hurts hurting shoot shoots shooting shot "
        "stab stabs stabbed stabbing strangle strangles strangled strangling töte tötet töten umbringen ermorde ermorden erschieße erschießen erwürge erwürgen "
        "tuer tuerai tuerons assassiner assassinerai étrangler poignarder matar mataré mataremos asesinar asesinaré apuñalar estrangular"
    ).split(),
    TARGET: "you your yours yourself he she him they them these those this people everyone dich euch ihn vous toi usted ustedes vosotros".split(),
    NEGATION: "not never no isn wasn don doesn didn won nobody without hardly nicht nie kein keine pas jamais nunca jamás".split(),
    REPORT: "said says told called calls quoted wrote claimed claims alleged according sagte schrieb dit affirma dijo escribió".split(),
}
SEED_WEIGHT = 2.0


# --- the lower transducer: letters to classes -------------------------------------------------

class Lexicon:
    """A trie whose nodes may end a word or, for any continuation, a beginning."""

    def __init__(self, learned: dict[str, float]):
        """learned: weight by word, or by beginning if it ends in '*'."""
        self.root: dict = {}
        for kind, words in WORDS.items():
            for word in words:
                self._add(word, kind, learned.get(word, SEED_WEIGHT if kind == INSULT else 1.0))
        for word, weight in learned.items():
            self._add(word, INSULT, weight)

    def _add(self, word: str, kind: int, weight: float) -> None:
        node, end = self.root, "$"
        if word.endswith("*"):
            word, end = word[:-1], "*"
        for letter in word:
            node = node.setdefault(letter, {})
        if end not in node or node[end][1] < weight:
            node[end] = (kind, weight)

    def read(self, word: str) -> tuple[int, float]:
        node, best = self.root, (ORDINARY, 0.0)
        for letter in word:
            node = node.get(letter)
            if node is None:
                return best
            if "*" in node and node["*"][1] > best[1]:
                best = node["*"]
        if "$" in node and node["$"][1] > best[1]:
            best = node["$"]
        return best


_PART = re.compile(r"[^\W_]+|[.!?;:|]+")


class Symbols(memo.Halves):
    """Chunks between white space to a number: 0 if ordinary throughout, else of a symbol sequence."""

    def __init__(self, lexicon: Lexicon, most: int = 16 << 20):
        super().__init__(most)
        self.lexicon, self.found, self.number = lexicon, [((ORDINARY, 0.0),)], {}

    def learnt(self, chunk: str) -> int:
        read = tuple((BREAK, 0.0) if part[0] in ".!?;:|" else self.lexicon.read(part) for part in _PART.findall(chunk.lower())) or self.found[0]
        n = 0
        if any(kind != ORDINARY for kind, _ in read):
            n = self.number.setdefault(read, len(self.found))
            if n == len(self.found):
                self.found.append(read)
        return n

    def forget(self) -> None:
        super().forget()
        del self.found[1:]
        self.number.clear()


# --- the upper transducer: classes to clause weight -------------------------------------------

#: What is left of an insult's weight, and of a threat's, that is negated or reported; what being addressed adds to an insult.
NEGATED, REPORTED, ADDRESSED = 0.4, 0.6, 1.3
#: What a target close behind an insult adds; a threat with its target behind and before it.
BEHIND, THREAT_BEHIND, THREAT_BEFORE = 0.5, 1.5, 0.5


def _negated(state: int, kind: int, _seen: tuple) -> tuple[int, float, float]:
    after = 0 if kind == BREAK else 3 if kind == NEGATION else max(0, state - 1)
    return after, NEGATED if kind == INSULT and state else 1.0, 0.0


def _reported(state: int, kind: int, _seen: tuple) -> tuple[int, float, float]:
    after = 0 if kind == BREAK else 1 if kind == REPORT else state
    return after, REPORTED if kind == INSULT and state else 1.0, 0.0


def _addressed(state: int, kind: int, _seen: tuple) -> tuple[int, float, float]:
    after = 0 if kind == BREAK else 5 if kind == TARGET else max(0, state - 1)
    return after, ADDRESSED if kind == INSULT and state else 1.0, 0.0


def _insulted(state: int, kind: int, _seen: tuple) -> tuple[int, float, float]:
    """How many words ago an insult passed: 2 one, 1 two, 0 more."""
    after = {BREAK: 0, INSULT: 2}.get(kind, max(0, state - 1))
    return after, 1.0, BEHIND if kind == TARGET and state else 0.0


def _threatened(state: tuple, kind: int, seen: tuple) -> tuple[tuple, float, float]:
    """(is a target known, what the waiting threat is worth); ``seen`` are the states of negation and report."""
    target, waits = state
    if kind == BREAK:
        return (False, 0.0), 1.0, 0.0
    if kind == TARGET:
        return (True, 0.0), 1.0, THREAT_BEHIND * waits
    if kind == THREAT:
        worth = (NEGATED if seen[0] else 1.0) * (REPORTED if seen[1] else 1.0)
        return (target, max(waits, worth)), 1.0, THREAT_BEFORE * worth if target else 0.0
    return state, 1.0, 0.0


def compose(*machines) -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
    """The product of (start, machine): next state, factor and amount by state and class; state 0 starts a clause.

    Each machine is told the states that those in front of it are in.
    """
    start = tuple(s for s, _ in machines)
    states, numbers = [start], {start: 0}
    then, factor, amount = [], [], []
    for state in states:  # grows while it runs
        rows = [[m(state[k], kind, state[:k]) for k, (_, m) in enumerate(machines)] for kind in range(7)]
        then.append([])
        for row in rows:
            after = tuple(x[0] for x in row)
            if after not in numbers:
                numbers[after] = len(states)
                states.append(after)
            then[-1].append(numbers[after])
        factor.append([math.prod(x[1] for x in row) for row in rows])
        amount.append([sum(x[2] for x in row) for row in rows])
    return then, factor, amount


GRAMMAR = compose((0, _negated), (0, _reported), (0, _addressed), (0, _insulted), ((False, 0.0), _threatened))


class Scorer:
    """Clause weights of whole texts, and what the curve reads of them."""

    N = 4

    def __init__(self, learned: dict[str, float], most: int = 16 << 20):
        self.symbols = Symbols(Lexicon(learned), most)
        self.telling = np.zeros(0, dtype=bool)

    def clauses(self, text: str) -> tuple[int, list[float]]:
        """The number of chunks, and the weights of the clauses that have any."""
        then, factor, amount = GRAMMAR
        chunks = text.split()
        if len(self.symbols.found) > SEQUENCES:
            self.symbols.forget()
            self.telling = self.telling[:0]
        codes = np.fromiter(map(self.symbols.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        found = self.symbols.found
        if len(self.telling) < len(found):
            self.telling = np.array([any(k in (INSULT, THREAT) for k, _ in x) for x in found])
        out: list[float] = []
        if not self.telling[codes].any():
            return len(chunks), out
        state, total = 0, 0.0
        for code in codes.tolist():
            for kind, weight in found[code]:
                total += amount[state][kind] + (factor[state][kind] * weight if kind == INSULT else 0.0)
                state = then[state][kind]
                if kind == BREAK:
                    if total:
                        out.append(total)
                    total = 0.0
        if total:
            out.append(total)
        return len(chunks), out

    def features(self, text: str) -> list[float]:
        n, weights = self.clauses(text)
        if not weights:
            return [0.0] * self.N
        total = math.fsum(weights)
        rate = math.log1p(300 * total / (n + 30))
        return [1.0, max(weights), math.log1p(total), rate]


# --- learning ----------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")


def word_features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        out.add(word)
        out.update([word[:k] + "*" for k in range(3, min(len(word), 11))])
    return out


def _counted(rows: DataFrame, only: set[str] | None) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: Counter = Counter()
        keep = held.value
        for batch in batches:
            for text in batch["text"]:
                found = word_features(text)
                some.update(found if keep is None else found & keep)
                if len(some) > 300_000:
                    yield pd.DataFrame({"feature": list(some), "n": list(some.values())})
                    some.clear()
        yield pd.DataFrame({"feature": list(some), "n": list(some.values())}, columns=["feature", "n"]).astype({"feature": object, "n": "int64"})

    return rows.select("text").mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def weigh(often: dict[str, int], base: dict[str, int], pos: int, neg: int, floor: float, z: float) -> dict[str, float]:
    """Weights of the features that mark label 1, from how many rows of each label have them."""
    found = {}
    for word, a in often.items():
        b = base.get(word, 0)
        odds = math.log((a + 0.1) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
        low = odds - z * math.sqrt(1 / (a + 0.1) + 1 / (b + 0.5) - (1 / (pos + 1) + 1 / (neg + 1)))
        if low >= floor:
            found[word] = min(low, 5.0)
    for word in sorted((w for w in found if w.endswith("*")), key=len):  # one word, or a longer beginning, is all that it stands for
        stem = word[:-1]
        if any(often.get(w, 0) >= 0.9 * often[word] for w in found if w != word and w.startswith(stem)):
            del found[word]
    for word in [w for w in found if w.endswith("*")]:  # a longer beginning that says no more is not needed
        stem = word[:-1]
        if any(found.get(stem[:k] + "*", 0) >= found[word] for k in range(3, len(stem))):
            del found[word]
    return found


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """By setting, weights of the words and beginnings that mark label 1; a sample of bounded rows has a bounded number of them."""
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return [{}]
    least = max(LEAST, min(least_rows(pos, neg, floor, z) for floor, z in SETTINGS))
    often = {r["feature"]: r["n"] for r in _counted(sample.where("label = 1"), None).where(F.col("n") >= least).collect()}
    base = {r["feature"]: r["n"] for r in _counted(sample.where("label = 0"), set(often)).collect()}
    return [weigh(often, base, pos, neg, floor, z) for floor, z in SETTINGS]


def least_rows(pos: int, neg: int, floor: float, z: float) -> int:
    """Rows of label 1 below which no feature can reach the floor, even if no row of label 0 has it."""
    a = 1
    while a < pos and math.log((a + 0.1) / (pos + 1)) - math.log(0.5 / (neg + 1)) - z * math.sqrt(1 / (a + 0.1) + 2 - (1 / (pos + 1) + 1 / (neg + 1))) < floor:
        a += 1
    return a


def cross_validate(rows: list[tuple[str, int]], settings: list[dict], folds: int = 5, threshold: float = THRESHOLD) -> list[dict]:
    """For each of ``settings`` (floor, z, least, features): log loss, precision and recall over ``rows(text, label)``, each scored by a model of the other folds.

    Inside those, as in ``fit``, two thirds give the words and the rest the curve. Run it on rows
    that are not held out.
    """
    part = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t, _ in rows]
    found = [word_features(t) for t, _ in rows]
    counts = []
    for k in range(folds):
        told: tuple[Counter, Counter] = (Counter(), Counter())
        size = [0, 0]
        for (_, label), p, f in zip(rows, part, found, strict=True):
            if p % folds != k and p // folds % 3:
                told[label].update(f)
                size[label] += 1
        counts.append((told, size))
    out = []
    for s in settings:
        y, p_of = [], []
        for k in range(folds):
            (base, often), (neg, pos) = counts[k]
            scorer = Scorer(weigh({w: n for w, n in often.items() if n >= s["least"]}, base, pos, neg, s["floor"], s["z"]))
            x = np.array([scorer.features(t) for t, _ in rows])[:, s["features"]]
            fit_on = np.array([p % folds != k and p // folds % 3 == 0 for p in part])
            asked, labels = np.array([p % folds == k for p in part]), np.array([v for _, v in rows], dtype=float)
            w = fit_curve(x[fit_on], labels[fit_on])
            p_of += (1 / (1 + np.exp(-np.clip(w[0] + x[asked] @ np.array(w[1:]), -30, 30)))).tolist()
            y += labels[asked].tolist()
        y, p = np.array(y), np.array(p_of)
        hit = p >= threshold
        q = np.clip(p, 1e-6, 1 - 1e-6)
        out.append({**s, "log_loss": float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()), "precision": float(y[hit].mean()) if hit.any() else 1.0, "recall": float(hit[y == 1].mean())})
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression, the intercept first; no coefficient of a feature is negative, so more weight never lowers a score."""
    use = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, use], y)
        bad = [k for k, v in zip(use, w[1:], strict=True) if v < 0]
        if not bad:
            out = dict(zip(use, w[1:], strict=True))
            return [w[0], *(out.get(k, 0.0) for k in range(x.shape[1]))]
        use.remove(min(bad, key=lambda k: w[1 + use.index(k)]))


def _newton(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * w
        pull[0] = 0
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - pull)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w.tolist()


#: For want of labels.
PLAIN_CURVE = [-3.0, 0.0, 0.5, 1.0, 0.5]


def two_fold_loss(x: np.ndarray, y: np.ndarray) -> float:
    """Log loss of curves that are fitted to one half of the rows and asked about the other, both ways."""
    loss, halves = 0.0, np.arange(len(y)) % 2 == 0
    for half in (halves, ~halves):
        w = fit_curve(x[half], y[half])
        p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x[~half] @ np.array(w[1:]), -30, 30))), 1e-6, 1 - 1e-6)
        loss -= float((y[~half] * np.log(p) + (1 - y[~half]) * np.log(1 - p)).sum())
    return loss / len(y)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """{"lexicon": weights, "curve": coefficients}: words from two thirds of the sample, choice of setting and curve from the rest."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(labelled_sample(docs, labels, "toxic", FOLDS, FOLD, sample), "sample")
    lexicons = learn_lexicons(rows.where("part <> 0"))
    held = docs.sparkSession.sparkContext.broadcast(lexicons)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(lexicon, 4 << 20) for lexicon in held.value]
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [[v for s in scorers for v in s.features(t)] for t in batch["text"]]})

    got = rows.where("part = 0").select("text", "label").mapInPandas(measure, "label int, x array<double>").toPandas()  # at most `sample` rows
    scratch.drop("sample")
    if got["label"].nunique() < 2:
        return {"lexicon": lexicons[0], "curve": PLAIN_CURVE}
    x, y = np.array(got["x"].tolist()).reshape(len(got), len(lexicons), Scorer.N), got["label"].to_numpy(dtype=float)
    order = np.lexsort((*x.reshape(len(x), -1).T, y))  # the same halves whatever order rows come in, and labels in both
    x, y = x[order], y[order]
    best = min(range(len(lexicons)), key=lambda k: (two_fold_loss(x[:, k], y), k))
    return {"lexicon": lexicons[best], "curve": fit_curve(x[:, best], y)}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` columns and a new one, 0 to 1."""
    if free(docs.columns, name) != [name]:
        raise ValueError(f"there is a column {name} already")
    held = docs.sparkSession.sparkContext.broadcast(json.dumps(model))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo.claim("toxicity")
        model = json.loads(held.value)
        scorer, curve = Scorer(model["lexicon"]), model["curve"]
        for batch in texts:
            raw = [curve[0] + sum(c * v for c, v in zip(curve[1:], scorer.features(t or ""), strict=True)) for t in batch]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in raw], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels) if model is None else model
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names."""
    (name,) = free(docs.columns, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
