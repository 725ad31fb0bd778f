"""Corpus operators on small tables: brute force, round trips, and the awkward cases of each."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.llm import chat, ego_join, exact_dedup, mixing, ngram_join, packing, pii, quality, template, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]
KEY = b"a key of the tests"


def odd_docs():
    base = " ".join(WORDS[:60])
    near = " ".join([*WORDS[:58], "x", "y"])
    rows = [(1, base), (2, base + " "), (3, near), (4, None), (5, ""), (6, " ".join(WORDS[100:180])), (7, "one two"), (8, "one  two"), (9, "solo"), (None, "no id here"), (10, " ".join(WORDS * 40)), (11, base), (11, base)]
    return [(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else "src1", None) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, docs, nothing):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in odd_docs():
        groups["".join((t or "").split())].append((-len(t or ""), i is None, i))
    want = sorted(((i, min(g)[2], len(g)) for g in groups.values() for _, _, i in g), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.keep_first(docs).count() == len(groups)
    again = exact_dedup.keep_first(spark.createDataFrame([(5, "same", "en", "s", 1)] * 3, DOCS))
    assert again.count() == 1 and again.columns == docs.columns


def test_index_grows(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "ab"), (4, "d")], "doc_id long, text string")
    exact_dedup.exact_dedup(one, path, "one").count()
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(two, path, "two").collect()}
    assert got == {3: (1, False), 4: (4, True)}
    again = {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(two, path, "two").collect()}
    assert again == {3: False, 4: True}
    assert spark.read.parquet(path).count() == 3


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_rows():
    """Rows with equal and near texts, repeated and null ids, null and empty texts."""
    draw = np.random.RandomState(0)
    rows = [(i, t) for i, t, *_ in odd_docs()]
    for k in range(80):
        words = list(draw.choice(WORDS, 60)) if k % 4 == 0 else words[: draw.randint(40, 60)] + [f"n{k}"] if draw.rand() < 0.3 else [w if draw.rand() > 0.02 else "z" for w in words]
        rows.append((None if k % 9 == 1 else 100 + k // 2 if k % 7 == 2 else 200 + k, " ".join(words)))
    lone = [f"u{k}" for k in range(80)]
    return [*rows, (None, " ".join(lone)), (None, " ".join(lone[:79])), (None, " ".join(lone[:79]))]


def test_ngram_join(spark, docs, nothing):
    """Row by row: rows of one id and text are told apart by how often they come."""
    rows = near_rows()
    sets = [shingle_set(t) for _, t in rows]
    links = [{j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in range(len(rows))]
    groups, want = [], []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        groups.append(frozenset(seen))
        want.append((rows[i][0], min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(links[i])))
    frame = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, set_id string, root int")
    got = ngram_join.near_duplicates(frame).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(want)
    assert sum(map(len, links)) > 60 and any(i is None and n for i, _, n in want)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    stay = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert not Counter(stay) - Counter(rows)
    group_of = dict(zip(rows, groups, strict=True))  # rows of one id and text are of one group, or without shingles
    assert len(stay) == len(set(groups)) and Counter(group_of[r] for r in stay if shingle_set(r[1])) == Counter({g for r, g in zip(rows, groups, strict=True) if shingle_set(r[1])})
    assert ngram_join.near_duplicates(nothing).count() == ngram_join.keep_one(nothing).count() == 0
    assert ngram_join.near_duplicates(docs).count() == len(odd_docs())


def test_ngram_recall_near_threshold(spark):
    """Pairs of similarity 0.8 to 0.84 against exact counts, and pairs just below."""
    draw, rows, want = np.random.RandomState(6), [], {}
    for k in range(400):
        words = [f"{k}-{j}" for j in draw.permutation(200)]
        n = int(draw.randint(14, 30))  # a cut of n words at the end and n new ones
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-n], *(f"{k}+{j}" for j in range(n))]))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        want[k] = len(a & b) / len(a | b)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [k for k, j in want.items() if 0.8 <= j < 0.84]
    assert len(close) > 40 and np.mean([got[2 * k] for k in close]) >= 0.99
    assert not any(got[2 * k] for k, j in want.items() if j < 0.8)


def test_ngram_blocks(spark, monkeypatch):
    """Groups larger than a block give what one block gives, whatever fills the blocks."""
    rows = [(k, " ".join([*WORDS[:100], f"t{k}"])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 9)
    for name, value in (("BLOCK", 7), ("BLOCK_ROWS", 5), ("BLOCK_BYTES", 4000)):
        monkeypatch.setattr(ngram_join, name, value)
        assert {(r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()} == {(0, 39)}


def test_pruning_keeps_what_may_reach():
    for n, need in ngram_join._NEED:
        assert need < 0.8 * n and need > 0.2 * n - 1


def test_mixing(spark, docs, nothing):
    rows = [(k, "a b c d", "en", f"s{k % 3}", 1) for k in range(60)] + [(100 + k, "a b", "fr", "s0", 1) for k in range(4)]
    table = spark.createDataFrame(rows, DOCS)
    plan = mixing.MixPlan(budget_share=0.5, domain_weights={}, lang_weights={})
    got = mixing.mix(table, plan).collect()
    leaves = defaultdict(int)
    for r in got:
        leaves[r["lang"], r["source"]] += len(r["text"].split())
    # 248 tokens, 124 wanted: 42, 41 and 41 to the domains; of s0's, fr can give 16 in two epochs and en gives the rest
    assert leaves["fr", "s0"] == 16 and leaves["en", "s0"] == 28
    assert leaves["en", "s1"] == leaves["en", "s2"] == 44
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(table.repartition(7), plan).collect()))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "epoch"]


def shared(wanted, children):
    """``children``: key to (cap, weight); what each is given, filling the full ones round by round in fractions."""
    given, spare = {}, Fraction(wanted)
    live = {k: (c, w) for k, (c, w) in children.items() if c > 0 and w > 0}
    while live:
        level = spare / sum(w for _, w in live.values())
        full = [k for k, (c, w) in live.items() if c <= level * w]
        if not full:
            exact = {k: level * w for k, (_, w) in live.items()}
            given |= {k: math.floor(v) for k, v in exact.items()}
            left = math.floor(spare) - sum(math.floor(v) for v in exact.values())
            for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[:left]:
                given[k] += 1
            break
        for k in full:
            given[k] = live.pop(k)[0]
            spare -= given[k]
    return given


def test_budgets_against_rounds(spark):
    """Random trees: the plan's SQL and the oracle's against filling round by round, in fractions."""
    import duckdb

    draw = random.Random(7)
    for trial in range(6):
        share = (0.3, 0.75, 1.9, 0.5, 0.05, 1.0)[trial]
        plan = mixing.MixPlan(share, 2, 17, {"0": 2, "1": 0, "2": 5}, {"en": 4, "fr": draw.randint(0, 3)}, {"a0": 3, "b2": 7})
        leaves = sorted({(d, lang, f"{s}{d}"): draw.choice((draw.randint(1, 9), draw.randint(1, 10**draw.randint(1, 11)))) for d in "0123" for lang in ("", "de", "en", "fr") for s in "abcde" if draw.random() < 0.7}.items())
        rows = [(*k, v) for k, v in leaves]
        weigh = lambda key, weights: weights.get(key, 1)
        cap = lambda n: sum(2 * t for k, t in leaves if k[: len(n)] == n)
        kids = lambda n: sorted({k[: len(n) + 1] for k, _ in leaves if k[: len(n)] == n})
        tables = (plan.domain_weights, plan.lang_weights, plan.source_weights)
        level = {(): math.floor(sum(t for _, t in leaves) * share)}
        for table in tables:
            level = {k: v for n, wanted in level.items() for k, v in shared(wanted, {c: (cap(c), weigh(c[-1], table)) for c in kids(n)}).items()}
        want = sorted((*k, v) for k, v in level.items() if v)
        got = mixing._targets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), plan).select("domain", "lang", "source", "target")
        assert sorted(map(tuple, got.collect())) == want
        con = duckdb.connect()
        con.execute("CREATE TABLE leaves (domain VARCHAR, lang VARCHAR, source VARCHAR, tokens BIGINT)")
        con.executemany("INSERT INTO leaves VALUES (?, ?, ?, ?)", rows)
        assert sorted(con.execute(f"WITH {mixing._tree_sql(plan, mixing._share_by_search)} SELECT domain, lang, source, target FROM targets").fetchall()) == want


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    got = packing.pack(docs.select("doc_id", "text"), path).collect()
    encode = Tokenizer.from_file(path).encode
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in {i: t for i, t, *_ in odd_docs() if i != 11}.items():
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by_doc[i], key=lambda r: r["piece"])] == [(k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)]
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(nothing.select("doc_id", "text"), path).count() == 0
    assert packing.sequences(docs.select("doc_id", "text"), path).count() == len(bins)


def test_word_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    ids, encode, draw = packing.WordIds(path, most=10_000), Tokenizer.from_file(path).encode, random.Random(5)
    letters = list("abcXYZ\u00e9\u00c9\u00dfŁ.,!$#;:?%&*'<|> \n\t09日é\u0130ıſµª\u0958")
    odd = ["", "  ", "\u0130,", "\u0958.", "don't we'll I'M", "<|endoftext|>x <|startoftext|>.", "<|ENDOFTEXT|> Ab <|EndOfText|>", "ÀÉÎ, ÑÜß. A\x85B ºª\xad", "...,,, a.b,c .a ,", "Ελλάδα. РУССКИЙ!!", "\u0301a \u200bz\r\n q", "x" * 5000]
    for text in odd + ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(2000)]:
        assert ids.of_text(text) == np.asarray(encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    assert len(ids) + len(ids.old) <= 2 * 10_000 // packing.memo.ENTRY_BYTES and max(map(len, ids)) <= ids.longest


def fewest(sizes, capacity):
    """Bins of the best packing, by trying every set that holds the longest piece left."""
    if not sizes:
        return 0
    first, rest, best = sizes[0], sizes[1:], len(sizes)
    for r in range(len(rest) + 1):
        for beside in itertools.combinations(range(len(rest)), r):
            if first + sum(rest[k] for k in beside) <= capacity:
                best = min(best, 1 + fewest([x for k, x in enumerate(rest) if k not in beside], capacity))
    return best


def n_bins(packing):
    return sum(bins for bins, _ in packing)


def test_dominance_loses_no_bin():
    """What the reduction fixes, and the best packing of what it leaves, are together a best packing."""
    draw, kinds = random.Random(3), set()
    for _ in range(400):
        capacity = draw.randint(6, 20)
        sizes = sorted((draw.randint(1 + capacity // draw.choice((2, 4, 9)), capacity) for _ in range(draw.randint(1, 7))), reverse=True)
        have = dict(Counter(sizes))
        fixed, left = packing.reduce_by_dominance(have, capacity)
        kinds |= {sum(v for _, v in held) for _, held in fixed}
        rest = sorted((k for k, v in left.items() for _ in range(v)), reverse=True)
        best = fewest(sizes, capacity)
        assert n_bins(fixed) + fewest(rest, capacity) == best, (sizes, capacity)
        assert best <= packing.pack_histogram(have, capacity).eval("sequence + (last_rank - first_rank - 1) // each").max() + 1 <= best + 1
    assert kinds == {1, 2, 3}
    assert packing.reduce_by_dominance({6: 1, 3: 1, 2: 2}, 13) == ([], {6: 1, 3: 1, 2: 2})  # all fit one bin, which no set of three can tell


def test_histogram_packing():
    draw = np.random.RandomState(1)
    for _ in range(200):
        sizes, counts = np.unique(draw.randint(1, 51, draw.randint(1, 300)), return_counts=True)
        have = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        fixed, left = packing.reduce_by_dominance(have, 50)
        used = Counter(left)
        for n, held in fixed:
            assert sum(size * each for size, each in held) <= 50
            for size, each in held:
                used[size] += n * each
        assert dict(used) == have
        table = packing.pack_histogram(have, 50)
        most = int((table["sequence"] + (table["last_rank"] - table["first_rank"] - 1) // table["each"]).max()) + 1
        assert -(-sum(k * v for k, v in have.items()) // 50) <= most <= n_bins(packing.best_fit_decreasing(have, 50))


def test_classifiers(spark, nothing):
    draw = np.random.RandomState(2)
    rows, labels = [], []
    for k in range(240):
        bad = k % 3 == 0
        words = [*draw.choice(WORDS, 40), *(["you", "grobnak"] * 3 if bad else [])]
        text = " ".join(draw.permutation(words)) if k % 2 else "| ".join(words) + " !!"
        rows.append((k, text, "en", "s", 1))
        labels.append((k, k % 2, int(bad)))
    table, known = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None), (None, "x", None, None, None)], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for got, column in ((toxicity.toxicity(table, known), 2), (quality.quality(table, known), 1)):
        found = {r["doc_id"]: r for r in got.collect()}
        assert len(found) == 243 and all(0 <= r["score"] <= 1 for r in found.values())
        held = [r for i, r in found.items() if r["held_out"]]
        assert {r["doc_id"] for r in held} == {k for k in found if k is not None and (zlib.crc32(str(k).encode()) % (4 if column == 2 else 3) == (2 if column == 2 else 1))}
        right = [found[k]["predicted"] == label[column] for k, label in enumerate(labels) if found[k]["held_out"]]
        assert np.mean(right) > 0.95
    assert toxicity.toxicity(nothing, known).count() == quality.quality(nothing, known).count() == 0
    assert toxicity.toxicity(table, known.limit(0)).count() == 243
    assert toxicity.keep_clean(table, known).columns == table.columns


def test_grammar():
    total = lambda t: sum(toxicity.Scorer({}).clauses(t)[1])
    assert total("you are an idiot") > total("an idiot") > total("he is not an idiot") > 0
    assert total("she said idiot") < total("she is an idiot")
    assert total("I will kill you") > 0 and total("kill the process") == 0 and total("kill the process. you") == 0
    assert total("I will kill all of you") == total("I will kill you") > total("you I will kill") > 0
    assert total("I will not kill you") == toxicity.NEGATED * total("I will kill you")
    assert total("he said I will kill you") < total("he and I will kill you")
    assert total("ich werde dich töten") > 0 and total("je vais vous tuer") > 0
    assert total("the moral story") == 0


def clause_weights(read, words):
    """Weights of the clauses by rule, one look at the words in front at a time."""
    out = []
    for clause in words:
        total = 0.0
        for k, word in enumerate(clause):
            kind, weight = read(word)
            front = [read(w)[0] for w in clause[:k]]
            negated = toxicity.NEGATION in front[-3:]
            reported = toxicity.REPORT in front
            if kind == toxicity.INSULT:
                total += weight * (toxicity.NEGATED if negated else 1) * (toxicity.REPORTED if reported else 1) * (toxicity.ADDRESSED if toxicity.TARGET in front[-5:] else 1)
            if kind == toxicity.THREAT and toxicity.TARGET in front:
                total += toxicity.THREAT_BEFORE * (toxicity.NEGATED if negated else 1) * (toxicity.REPORTED if reported else 1)
            if kind == toxicity.TARGET:
                if toxicity.INSULT in front[-2:]:
                    total += toxicity.BEHIND
                since = len(front) - front[::-1].index(toxicity.TARGET) if toxicity.TARGET in front else 0
                waits = [(toxicity.NEGATED if toxicity.NEGATION in front[max(0, j - 3) : j] else 1) * (toxicity.REPORTED if toxicity.REPORT in front[:j] else 1) for j in range(since, k) if front[j] == toxicity.THREAT]
                total += toxicity.THREAT_BEHIND * max(waits, default=0)
        out.append(total)
    return [t for t in out if t]


def test_grammar_against_rules():
    draw, scorer = random.Random(8), toxicity.Scorer({"grob*": 3.0})
    words = ["idiot", "kill", "you", "not", "said", "tree", "house", "grobnak", "töten"]
    for _ in range(1500):
        clauses = [draw.choices(words, k=draw.randint(1, 12)) for _ in range(draw.randint(1, 3))]
        got = scorer.clauses(". ".join(" ".join(c) for c in clauses))[1]
        assert got == pytest.approx(clause_weights(scorer.symbols.lexicon.read, clauses)), clauses


def test_cross_validation():
    draw = random.Random(4)
    rows = [(" ".join(draw.choices(WORDS, k=30) + (["grobnak", "you"] * 2 if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(200)]
    good, poor = toxicity.cross_validate(rows, [{"least": 3, "floor": 0.7, "z": 1.6, "features": [0, 1]}, {"least": 3, "floor": 9.0, "z": 1.6, "features": [0, 1]}])
    assert good["recall"] == good["precision"] == 1 and good["log_loss"] < 0.1 < poor["log_loss"]
    assert all(toxicity.weigh({"w": n}, {}, pos, neg, *s) == {} for s in toxicity.SETTINGS for pos, neg in ((5, 20), (900, 9000)) for n in range(1, toxicity.least_rows(pos, neg, *s)))
    y = np.array([0.0, 0.0, 1.0, 1.0] * 10)
    assert toxicity.two_fold_loss(y[:, None] + 0.01, y) < 0.3 < toxicity.two_fold_loss(np.zeros((40, 1)), y)


def split_gain(g, h, left, right, least, ridge):
    gl, hl, gr, hr = (sum(v[r] for r in side) for side in (left, right) for v in (g, h))
    return -1.0 if hl < least / 4 or hr < least / 4 else gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)


def test_trees_against_naive_search():
    """No cut between two values of any column is better than the one taken; leaves and scores by plain sums and walks."""
    draw = np.random.RandomState(5)
    for _ in range(4):
        x = np.round(draw.normal(size=(36, 3)), 1)
        y = (x[:, 0] * x[:, 1] + 0.4 * draw.normal(size=36) > 0).astype(float)
        model = quality.fit_trees(x, y, trees=4, depth=3, rate=0.3, bins=1500, least=2.0)
        margins, cuts = np.full(36, np.log(y.mean() / (1 - y.mean()))), 0
        assert model["base"] == pytest.approx(margins[0])
        for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"], strict=True):
            p = 1 / (1 + np.exp(-margins))
            g, h = p - y, p * (1 - p)
            at = {0: list(range(36))}
            for node in range(7):
                rows = at[node]
                best = max(split_gain(g, h, [r for r in rows if x[r, j] <= v], [r for r in rows if x[r, j] > v], 2.0, 1.0) for j in range(3) for v in np.unique(x[:, j])[:-1])
                sides = [[r for r in rows if (x[r, feature[node]] > threshold[node]) == side] for side in (False, True)]
                at[2 * node + 1], at[2 * node + 2] = sides
                if np.isfinite(threshold[node]):
                    cuts += 1
                    assert split_gain(g, h, *sides, 2.0, 1.0) == pytest.approx(best)
                else:
                    assert best <= 1e-6 + 1e-9
            for k in range(8):
                for r in at[7 + k]:
                    margins[r] -= 0.3 * sum(g[i] for i in at[7 + k]) / (sum(h[i] for i in at[7 + k]) + 1.0)
                    assert leaf[k] == pytest.approx(-0.3 * sum(g[i] for i in at[7 + k]) / (sum(h[i] for i in at[7 + k]) + 1.0))
        assert cuts > 8 and quality.predict(model, x) == pytest.approx(1 / (1 + np.exp(-margins)))


def test_clashing_names(spark):
    """A caller's own columns come out as they went in, whatever they are called."""
    names = ["Score", "entities", "epoch", "__domain", "__epochs", "set_id", "id__", "digest__", "__pii", "label", "root", "copies"]
    frame = spark.createDataFrame([(k, " ".join(WORDS[k * 40 : k * 40 + 30]), "en", "s", 1, *[f"{n}{k}" for n in names]) for k in range(6)] * 2, DOCS + "".join(f", `{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = Counter(map(tuple, frame.collect()))
    one = Counter(set(rows))
    assert Counter(map(tuple, toxicity.keep_clean(frame, labels).collect())) == rows
    assert Counter(map(tuple, exact_dedup.keep_first(frame).collect())) == one
    assert Counter(map(tuple, ngram_join.keep_one(frame).collect())) == one
    mixed = mixing.mix(frame, mixing.MixPlan(budget_share=1.0, max_epochs=1, domain_weights={}, lang_weights={}), epoch="nth")
    assert mixed.columns == [*frame.columns, "nth"] and Counter(tuple(r)[:-1] for r in mixed.collect()) == rows
    hidden = pii.pseudonymise(frame, KEY, entities="found")
    assert hidden.columns == [*frame.columns, "found"] and Counter(tuple(r)[:-1] for r in hidden.collect()) == rows
    for wrong in (lambda: mixing.mix(frame), lambda: pii.pseudonymise(frame, KEY), lambda: quality.score(frame, {})):
        with pytest.raises(ValueError):
            wrong()


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b <|end|>\n<|turn|>user<|says|>", "\\l<| |> <<SYS>> <</SYS>>", "", None, "plain\ntext"]
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "")
        assert not any(c in chat.escape(t or "") for c in chat.CONTROL)
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(None, None, None, "x"), (2, 1, "user", "b"), (2, 1, "user", "a")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {r["conv_id"]: r for r in made.collect()}
    assert chat.read_turns(by[1]["formatted"]) == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(texts)]
    assert [chat.unescape(by[1]["formatted"][a:b]) for a, b in zip(by[1]["loss_starts"], by[1]["loss_ends"], strict=True)] == [t or "" for t in texts[1::2]]
    assert chat.read_turns(by[2]["formatted"]) == [("user", "a"), ("user", "b")] and set(by) == {1, 2, None}
    assert chat.read_back(made.limit(0)).count() == 0
    # Segments of a few turns say what whole conversations say, straight away and from a shuffled table.
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(chat.read_back(made).collect(), key=repr)
    short = chat.format_conversations(frame, segment=40)
    assert short.where("conv_id = 1").count() > 2
    assert sorted(chat.read_back(short, in_order=True).collect(), key=repr) == sorted(chat.read_back(short.repartition(5)).collect(), key=repr) == want


def test_templates(monkeypatch):
    run = lambda t, **v: "".join(p for p, _ in template.compile_template(t)(v))
    assert run("{% for m in ms %}{{ loop.index }}{{ m.x | upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"x": "a"}, {"x": "b"}]) == "1A,2B"
    assert run("{% set a = 1 + 2 %}{{ a }}{% if a == 3 and 'b' in 'abc' %}y{% elif a %}e{% else %}n{% endif %}{# no #}") == "3y"
    assert template.fold(template.parse("a{{ 'b' ~ (1 + 1) }}{% if 1 == 2 %}x{% endif %}c"), template.FILTERS)[1].__len__() == 1
    assert template.compile_template("u{% generation %}g{{ x }}{% endgeneration %}")({"x": "h"}) == [("u", False), ("g", True), ("h", True)]
    assert run("{{ '}}' }}{% if '%}' in x %}y{% endif %}{{ \"it's\" }}", x="a%}") == "}}yit's"
    assert run("{% if 'a' not in x and not 'b' in x %}y{% endif %}", x="cd") == "y"
    assert run("{% if false %}{{ 1 + 'a' }}{{ none | length }}{% endif %}x") == "x"
    for late in ("{{ 1 + 'a' }}", "{{ none | length }}", "{{ x | length }}", "{% for a in x %}{% endfor %}", "{{ 'a' in 1 }}", "{% set a = 'ab' %}{% for i in y %}{% set b = a ~ a %}{{ a }}{% endfor %}"):
        render = template.compile_template(late)
        with pytest.raises(template.TemplateError):
            monkeypatch.setattr(template, "MOST_CHARS", 100)
            render({"x": 5, "y": [0] * 200})
    monkeypatch.setattr(template, "MOST_STEPS", 50)
    with pytest.raises(template.TemplateError):
        run("{% for i in y %}{% for j in y %}{% endfor %}{% endfor %}", y=[0] * 20)
    for bad in ("{{ 'a }}", "{{ a", "{% if a", "{{ a not b }}", "{{ a b }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ x.__class__.__mro__() }}", "{{ 'x' | no }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    assert run("{{ x.__class__ }}", x="s") == ""


def test_warc(spark, monkeypatch):
    big = "é" * 300_000
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/", big), (4, "u", None), (5, "u", ""), (6, "u", "x\r\n\r\nWARC/1.1\r\n"), (7, "u", big), (None, "u", "same")]
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    import base64
    import hashlib

    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 2, 2: None, 3: 7, 4: 5, 5: None, 6: None, 7: None, None: 2}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    scratch = warc.Scratch(spark, "t")
    manifest = warc.write_archives(warc.chunk_table(pages, scratch, chunk=1000), scratch.path("a"), scratch)
    chunks = warc.read_archives(manifest, scratch.path("a"), chunk=1000).where("page_id = 7").orderBy("chunk_no").collect()
    assert len(chunks) == 600 and b"".join(bytes(c["data"]) for c in chunks).decode() == big and [c["last"] for c in chunks].count(True) == 1
    # Repeated rows, of one url or of several; short payloads are all responses.
    rows = [(1, "u", "same")] * 3 + [(1, None, "same"), (1, "a", "same"), (2, "u", "other"), (2, "u", "other"), (None, None, "other"), (3, "u", ""), (4, "u", "")]
    again = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least, n_responses in ((0, 3), (1, 4), (5, 8), (6, 10)):
        got = warc.archive_round_trip(again.repartition(4), least).collect()
        assert Counter((r["page_id"], r["payload_bytes"]) for r in got) == Counter((i, len(h)) for i, _, h in rows)
        assert sum(r["record_type"] == "response" for r in got) == n_responses
        assert all((r["refers_to"] is None) == (r["record_type"] == "response") for r in got)
    # A payload that isn't what its head says is an error, in the writer and in the reader.
    table = warc.chunk_table(pages, scratch, chunk=1000)
    with pytest.raises(Exception, match="announced"):
        warc.write_archives(table.withColumn("sha1", F.repeat(F.lit("0"), F.lit(40))), scratch.path("b"), scratch)
    import gzip
    import io

    head = warc.record_head("r", 1, None, 3, hashlib.sha1(b"abc").hexdigest(), None)
    assert len(list(warc.read_records(io.BytesIO(gzip.compress(head + b"abc\r\n\r\n"))))) == 1
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(gzip.compress(head + b"abd\r\n\r\n"))))


def test_pii(spark, docs, nothing):
    cases = ["mail anna.16@mail8.example.com now", "call +1 (017) 555-7713.", "from 169.122.221.182 to 10.0.0.1", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "card 4242424242424242!", "Dear Mrs. Alice Smith and Mr Smith"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*cases, *cases, None, "", "nothing here"])]
    made = pii.pseudonymise(spark.createDataFrame(rows, DOCS), KEY)
    got = {r["doc_id"]: r for r in made.collect()}
    for k, t in enumerate(cases):
        assert got[k]["text"] == got[k + len(cases)]["text"] != t and (k == 2 or len(got[k]["text"]) == len(t))
        assert all(e["entity"] not in got[k]["text"] for e in got[k]["entities"])
    assert pii.luhn("4242424242424242") and pii.luhn(got[4]["entities"][0]["surrogate"])
    names = [e for e in got[5]["entities"]]
    assert names[0]["surrogate"] in pii.GIVEN["f"] and names[1]["surrogate"] == names[2]["surrogate"]
    assert pii.collisions(made).isEmpty() and got[12]["text"] is None
    assert len({pii.shifted(x, 97, b"k") for x in range(97)}) == 97 and all(pii.shifted(x, 97, b"k") != x for x in range(97))
    assert len({pii.surrogate("given", n, KEY) for n in [*pii.GIVEN["m"], "Zed", "Bob"]}) == 22
    assert pii.pseudonymise(nothing, KEY).count() == 0


@pytest.mark.parametrize("block, leaf, tile", [(1024, 128, 16 << 20), (16, 4, 1 << 12)])
def test_ego_join(spark, monkeypatch, block, leaf, tile):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("TILE_BYTES", tile)):
        monkeypatch.setattr(ego_join, name, value)
    draw = np.random.RandomState(4)
    x = draw.normal(size=(300, 8))
    x[100:200] = x[:100] + draw.normal(size=(100, 8)) * 0.25
    rows = [(k, [float(v) for v in r], int(k % 100 % 3) if k % 50 else None) for k, r in enumerate(x.astype(np.float32))]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] + [0.0] * 6, 1), (1003, [float("nan")] * 8, 1), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1)]
    got = {r["vec_id"]: r for r in ego_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {k: np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for k, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: lab for k, _, lab in rows}
    links = {k: {j for j in unit if j != k and len(unit[j]) == len(unit[k]) and label[j] == label[k] and unit[j] @ unit[k] >= 0.93} if k in unit else set() for k in label}
    assert sum(map(len, links.values())) > 20
    for k in label:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(links[k]), min(seen), k == min(seen))
    assert ego_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= now.count() > 0


def test_pii_names(spark):
    text = "Dr Anna Meyer met Frau Anna Meyer. Anna left, Meyer stayed, Annabel too; Mr Ben Low, Dr Ben Low, Mrs Ben Low."
    made = pii.rewrite(text, KEY)
    of = {(k, e): set() for k, e, _ in made[1]}
    for k, e, s in made[1]:
        of[k, e].add(s)
    assert set(map(len, of.values())) == {1} and len(made[1]) == 12 and len(of) == 4
    assert "Annabel" in made[0] and not any(w in made[0].replace("Annabel", "").split() for w in ("Anna", "Meyer", "Ben", "Low"))
    shapes = [a + b + c for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxyz"]
    assert len({pii.surrogate("given" if k % 2 else "surname", n, KEY) for k, n in enumerate(shapes)}) == len(shapes)
    # One identity a name: alone, with a surname, hyphenated, as a part; listed ones keep their gender.
    text = "Dr Maria called. Dr Maria Lopez-Klein and Mrs Lopez met Maria; Klein left. Mr Zed, then Mr Zed Maria."
    told = pii.rewrite(text, KEY)[1]
    by = {(e, n) for _, e, n in told}
    assert len({e for e, _ in by}) == len(by) and {e for e, _ in by} == {"Maria", "Lopez-Klein", "Lopez", "Klein", "Zed"} and len(told) == 9
    one = dict(by)
    assert one["Lopez-Klein"] == f"{one['Lopez']}-{one['Klein']}" and one["Maria"] in pii.GIVEN["f"]


def test_pii_other_scripts():
    """No letter of a name is left for want of an alphabet; forms without another member are masked."""
    for name in ("李雷", "Łukasz Żak", "Δημητρίου", "Ольга Ёжик", "Ĳsbrand", "محمد", "Ø", "E\u0301lan"):
        made, told = pii.rewrite(f"Mr {name} here", KEY)
        assert told and not set(name.replace(" ", "").replace("\u0301", "")) & set(made[3:-5].replace("\u0301", "")) or all(a != b for _, a, b in told), name
        for _, a, b in told:
            assert len(a) == len(b) and all(x == y or (x.isupper(), x.isalpha()) == (y.isupper(), y.isalpha()) for x, y in zip(a, b, strict=True))
    made, told = pii.rewrite("write иван@почта.рф or ivan@mail.example", KEY)
    assert [k for k, _, _ in told] == ["email", "email"] and "иван" not in made and made.endswith(".example") and ".рф " in made
    block = [chr(k) for k in range(0x141, 0x17E) if chr(k).isupper()]
    assert len({pii.surrogate("surname", a + b, KEY) for a in block for b in block}) == len(block) ** 2
    assert pii.surrogate("secret", "++++----", KEY) == "[secret]"


def test_pii_takes_another_key_on_collision(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen, plain = [], pii.pseudonymise

    def poor(docs, key):
        seen.append(key)
        made = plain(docs, key)
        return made if len(seen) > 1 else made.withColumn("entities", F.transform("entities", lambda e: e.withField("surrogate", F.lit("same"))))

    monkeypatch.setattr(pii, "pseudonymise", poor)
    docs = spark.createDataFrame([(1, "Mr Ben Low"), (2, "Mr Tim Low"), (3, "1.2.3.4 and 01.2.3.4 and Dr Ø")], "doc_id long, text string")
    got = pii.checked(docs, KEY).collect()
    assert len(seen) == 2 and len(set(seen)) == 2 and len(got) == 3
    with pytest.raises(ValueError):
        seen.clear()
        pii.checked(docs, KEY, tries=1)


def test_pii_hex_without_digits():
    for text in ("deadbeefdeadbeef", "deadbeef" * 4, "DEADBEEF" * 4, "1234" * 8, "dead1234"):
        made = pii.rewrite(f"token = {text}", KEY)[1]
        assert len(made) == 1 and made[0][0] == "hex" and made[0][2] != text and len(made[0][2]) == len(text)
        assert (made[0][2].isalpha(), made[0][2].isdigit()) == (text.isalpha(), text.isdigit())
    turns = iter([True, False] * 200_000)
    assert pii.reshape("11", b"k", "x", lambda t: next(turns)) is None


def test_pii_more_forms():
    cases = {
        "phone": ["(743) 555-3824", "030 1234567", "(030) 1234567", "743-555-3824", "+1 (017) 555-7713"], "card": ["3782 822463 10005", "3782-822463-10005"],
        "ipv6": ["2001:db8::8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "2001:0DB8:0000:0000:0000:8A2E:0370:7334"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    }
    for kind, texts in cases.items():
        for t in texts:
            made, told = pii.rewrite(f"see {t}, then.", KEY)
            assert [(k, e) for k, e, _ in told] == [(kind, t)], t
            assert made == f"see {told[0][2]}, then." and told[0][2] != t
            assert [k for _, _, k in pii.find_entities(made)] == [kind]
    for t in ("at 12:30:45 on 2024-01-15, std::vector", "in 05 2024 (1999) 123-145", "DE00 3704 0044", "0.5 or 0,25 and 1999 123456"):
        assert pii.find_entities(t) == [], t
    assert len({pii.surrogate("ipv6", f"2001:db8::{x:x}", KEY) for x in range(16)} | {pii.surrogate("ipv6", f"2001:DB8::{x:X}", KEY) for x in range(16)}) == 32
    assert len({pii.surrogate("phone", f"(0{x:02d}) 5", KEY) for x in range(100)} | {pii.surrogate("phone", f"({x:03d}) 5", KEY) for x in range(100, 1000)}) == 1000


def test_index_demands_batch_names(spark, tmp_path):
    path = f"file://{tmp_path}/named"
    one, two = (spark.createDataFrame([(k, t, "en", "s", 1)], DOCS) for k, t in ((1, "first"), (2, "second")))
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(one, path)
    assert [exact_dedup.keep_first(one, path, "a").count() for _ in range(2)] == [1, 1]
    assert exact_dedup.keep_first(two, path, "b").count() == 1


def test_index_reopened(spark, tmp_path):
    """Another partition count, a batch name that comes again with other rows, a crash in the middle of an append."""
    path, frame = f"file://{tmp_path}/index", lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = [(k, f"text {k}") for k in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tables = len(spark.catalog.listTables())
    try:
        assert exact_dedup.exact_dedup(frame(first), path, "a").where("kept").count() == 40
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got = exact_dedup.exact_dedup(frame([(100 + k, t) for k, t in first] + [(200, "new")]), path, "b").collect()
        assert len(got) == 41 and [r["doc_id"] for r in got if r["kept"]] == [200]
        more = frame([*first, (300, "more"), (301, "more ")])
        assert {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(more, path, "a").collect()} == {**{k: True for k, _ in first}, 300: False, 301: True}
        assert exact_dedup.keep_first(more, path, "a").count() == 41
        index = exact_dedup.DigestIndex(spark, path)
        assert index.files().count() == index.files().select("digest").distinct().count() == 42 and index.buckets == int(before)
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, buckets=9)
        # A crash that left some of the files of a batch: the rest is appended when the batch comes again.
        index.append(exact_dedup.digest_rows(frame([(400, "c1"), (401, "c2")])), "c")
        whole = exact_dedup.exact_dedup(frame([(400, "c1"), (401, "c2"), (402, "c3")]), path, "c").collect()
        assert sorted(r["doc_id"] for r in whole if r["kept"]) == [400, 401, 402] and index.files().count() == 45
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(spark.catalog.listTables()) == tables


def test_keep_one_goes_by_row(spark):
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(1, b + " x"), (5, a), (5, b), (7, a + " z"), (8, "short"), (8, "brief"), (9, " ".join(WORDS[200:260])), (9, " ".join(WORDS[200:260]) + " y"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = ngram_join.keep_one(docs)
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    nine = [k for k in kept if k[0] == 9]
    assert len(nine) == 1 and nine[0] in rows
    assert [k for k in kept if k[0] != 9] == sorted([(1, b + " x"), (5, a), (8, "short"), (8, "brief")], key=repr)
    assert got.columns == docs.columns
