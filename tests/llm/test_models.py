"""Operators 1, 2, 9 and 10: held-out accuracy, exact parts against brute force, edges."""

import itertools
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import EDGES, labels, table

from dqengine.llm.learning import labelled_sample
from dqengine.llm import langid, quality_crf, queries, suffix_tree, toxicity
from dqengine.llm.tables import fold

FOLDER = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_language_held_out(spark):
    got = queries.op1_langid(spark, FOLDER).filter("held_out").join(read(spark, "documents"), "doc_id")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.98


def test_language_backs_off():
    model = langid.LanguageModel(
        ("aa", "bb"),
        {0: np.sort(langid._words(["known"])[3])} | {n: np.zeros(0, np.uint64) for n in (5, 4, 2)}
        | {3: np.sort(langid._grams(*langid._words(["xyz"])[:3], 3)[0]), 1: np.sort(langid._grams(*langid._words(["q"])[:3], 1)[0])},
        {0: np.array([[5.0, 0.0]]), 3: np.tile([0.0, 2.0], (3, 1)), 1: np.array([[1.0, 0.0]])} | {n: np.zeros((0, 2)) for n in (5, 4, 2)},
    )
    total, letters = model.scores(["known", "Known known", "xyz", "xyzq", "q", "7 !", ""])
    # the 1-gram of "xyzq" counts for nothing: a longer n-gram of the word is known
    assert total.tolist() == [[5, 0], [10, 0], [0, 2], [0, 2], [1, 0], [0, 0], [0, 0]]
    assert letters.tolist() == [True] * 5 + [False] * 2


def test_language_edges(spark):
    rows = [(i, f"the cat and the dog number {i}") for i in range(30)] + [(100 + i, f"le chat et le chien {i}") for i in range(30)]
    learnt = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 100, "en").otherwise("fr"))
    model = langid.train(learnt)
    got = table(spark, EDGES).select("doc_id", langid.predict(model, F.col("text")).alias("g")).select("doc_id", "g.*").collect()
    by_id = {r["doc_id"]: (r["lang"], r["score"]) for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == ("und", 0.0) and by_id[5][0] == "en" and len(got) == len(EDGES)
    assert all(0 <= r["score"] <= 1 and r["lang"] in ("en", "fr", "und") for r in got)
    blank = langid.train(learnt.limit(0))
    assert {r[0] for r in table(spark, EDGES).select(langid.predict(blank, F.col("text"))["lang"]).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 4, 4 + 6])
    emit, turn = rng.normal(size=(10, 2)), rng.normal(size=(2, 2))
    marginal, pair, whole = quality_crf.forward_backward(emit, turn, first)
    wanted = np.zeros((2, 2))
    for a, b, z in zip(first[:-1], first[1:], whole):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weights = np.exp([sum(emit[a + i, s] for i, s in enumerate(p)) + sum(turn[s, t] for s, t in zip(p, p[1:])) for p in paths])
        assert z == pytest.approx(np.log(weights.sum()))
        for i in range(b - a):
            assert marginal[a + i, 1] == pytest.approx(sum(w for w, p in zip(weights, paths) if p[i]) / weights.sum())
        for w, p in zip(weights, paths):
            for s, t in zip(p, p[1:]):
                wanted[s, t] += w / weights.sum()
    assert pair == pytest.approx(wanted)


def test_line_features_cut_lines_as_split_does():
    texts = ["", "a\nb", "\n", "a A !!\n\nx x x\n", None, "***"]
    raw, size, first = quality_crf.line_features(pa.array(texts))
    assert np.diff(first).tolist() == [len((t or "").split("\n")) for t in texts]
    assert size.tolist() == [len(x) for t in texts for x in (t or "").split("\n")]
    share = dict(zip(quality_crf.SHARES, raw[first[3] + 2]))
    assert share["repeated"] == share["stutter"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("name, label, least", [("op2_quality_crf", "quality", 0.95), ("op10_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    got = queries.QUERIES[name](spark, FOLDER).filter("held_out").join(read(spark, "labels"), "doc_id")
    right, n, low, high = got.agg(F.count_if(F.col(label) == F.col("predicted")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right / n > least and 0 <= low <= high <= 1


@pytest.mark.parametrize("kind, label", [(quality_crf, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, kind, label):
    rows = [(i, f"a plain line of words number {i}") for i in range(40)] + [(100 + i, f"SPAM!! SPAM!! ### vile {i}") for i in range(40)]
    marks = labels(spark, [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)] + [(0, None, None), (0, 1, 0), (7777, 1, 0)])
    model = kind.train(table(spark, rows), marks)
    got = {r["doc_id"]: r["s"] for r in table(spark, rows + EDGES).select("doc_id", kind.score(model, F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert (got[30] > 0.9 and got[130] < 0.1) if label == "quality" else (got[30] < 0.1 and got[130] > 0.9)
    assert got[1] == got[2] or math.isclose(got[1], got[2])
    for part in (marks.limit(0), marks.filter(F.col(label) == 1)):
        model = kind.train(table(spark, rows), part)
        scores = {round(r[0], 9) for r in table(spark, EDGES).select(kind.score(model, F.col("text"))).collect()}
        assert len(scores) == 1 and scores.pop() >= 0.5 - 1e-9
    assert table(spark, []).select(kind.score(model, F.col("text"))).count() == 0


def python_base(rows):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    split = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)) + [None] for i, t, _ in rows}
    count = Counter(w for i, _, held in rows if not held for w in split[i])
    n, v = sum(count.values()), len(count)
    return {i: (h, len(split[i]), sum(count[w] > 0 for w in split[i]), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split[i])) for i, _, h in rows}


def test_suffix_tree_base_and_gain(spark):
    docs = read(spark, "documents").withColumn("held", fold("doc_id", 7) == 2)
    want = python_base([(r["doc_id"], r["text"], r["held"]) for r in docs.collect()])
    got = queries.op9_suffix_tree(spark, FOLDER).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    for held in (True, False):
        own = [r for r in got if r["held_out"] == held]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_suffix_tree_is_a_distribution(spark):
    """In every state the chances of all words, the end and the unknown word add up to one."""
    rows = [(i, "the cat sat on the mat . the dog sat on the log " + ("zebra " if i % 3 else "") + f"w{i}") for i in range(40)]
    docs = table(spark, rows).select("doc_id", F.lit(False).alias("held_out"), "text")
    packed = docs.mapInArrow(suffix_tree._pack, suffix_tree.PACKED).persist()
    listed = packed.select("piece", "words", "n").mapInArrow(suffix_tree._listed, "piece long, place int, word long, n long")
    counts = listed.groupBy("word").agg(F.sum("n").alias("c"))
    tree = suffix_tree.grow(packed, counts, 40, least=0.01)
    assert len(tree.contexts[0][0]) > 3 and len(tree.contexts[1][0])
    spelt = sorted({w for _, t in rows for w in t.split()})
    data, offsets = suffix_tree.string_bytes(pa.array(spelt))
    hashes = dict(zip(spelt, suffix_tree.word_hashes(data, offsets[:-1], offsets[1:])))
    count = {r["word"]: r["c"] for r in counts.collect()}
    known = {w: count[int(h.astype(np.int64))] for w, h in hashes.items()}
    assert len(count) == len(known)
    vocabulary = [*hashes.values(), suffix_tree.END, np.uint64(99)]
    times = np.array([*known.values(), 40, 0])
    for before in ([], ["the"], ["on", "the"], ["sat", "on", "the"], ["zebra"], ["w1"]):
        head = [suffix_tree.BEGIN, *[hashes[w] for w in before]]
        symbols = np.array([x for v in vocabulary for x in (*head, v)], np.uint64)
        size = len(head) + 1
        place = np.tile(np.arange(size), len(vocabulary))
        at = np.arange(size - 1, len(symbols), size)
        assert tree.chances(symbols, place, at, times).sum() == pytest.approx(1)


def python_tree_scores(rows, depth):
    """Contexts kept by the divergence test and the log10 probability of every text, from the definitions."""
    begin, end = "<b>", "<e>"
    texts = {i: [begin, *re.findall(r"[^\x20\x09-\x0D]+", t or ""), end] for i, t, _ in rows}
    learnt = [texts[i] for i, _, held in rows if not held]
    count = Counter(w for t in learnt for w in t[1:])
    tokens, types = sum(count.values()), len(count)
    n1, n2 = (sum(c == k for w, c in count.items() if w != end) for k in (1, 2))
    discount = (n1 + 1) / (n1 + 2 * n2 + 2)
    n = {(w,): c for w, c in count.items() if c >= 2 or w == end} | {(begin,): len(learnt)}
    chance = {r: (c - discount) / tokens for r, c in n.items()}
    left, share, keep = {}, {}, {}
    for length in range(2, depth + 2):
        runs = Counter(tuple(t[k : k + length]) for t in learnt for k in range(len(t) - length + 1))
        runs = {r: c for r, c in runs.items() if c >= 2}
        for head in {r[:-1] for r in runs}:
            own = {r: c for r, c in runs.items() if r[:-1] == head}
            seen, total = sum(own.values()), n[head]
            left[head] = min(max(1 - (seen - 0.5 * len(own)) / total, 1e-9), 1.0)
            value = (total - seen) * math.log(left[head])
            for r, c in own.items():
                share[r] = (c - 0.5) / total
                chance[r] = left[head] * chance[r[1:]] + share[r]
                value += c * math.log(chance[r] / chance[r[1:]])
            keep[head] = value >= len(own) * math.log(tokens)
        n |= runs
    for head in sorted(left, key=len, reverse=True):  # suffixes stay with what they end
        if keep[head] and len(head) > 1:
            keep[head[1:]] = True

    def at(text, k):
        w = text[k]
        p = (count[w] - discount) / tokens if count[w] else types * discount / tokens
        for d in range(1, min(depth, k) + 1):
            context = tuple(text[k - d : k])
            if not keep.get(context):
                break
            p = left[context] * p + share.get((*context, w), 0.0)
        return p

    return {i: sum(math.log10(at(t, k)) for k in range(1, len(t))) for i, t in texts.items()}, sum(keep.values())


@pytest.mark.parametrize("depth", [2, 4])
def test_suffix_tree_equals_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(suffix_tree, "SLICE_RUNS", 100)  # many slices
    rng = np.random.default_rng(8)
    phrases = [" ".join(f"p{i}x{k}" for k in range(9)) for i in range(5)]
    rows = []
    for i in range(90):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else " ".join(f"w{x}" for x in rng.integers(0, 30, 6)) for _ in range(rng.integers(0, 6))]
        rows.append((i, " ".join(parts), bool(i % 5 == 0)))
    want, kept = python_tree_scores(rows, depth)
    assert kept > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(5)
    got = suffix_tree.score_texts(docs, F.col("held"), depth=depth).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("runs", [40, 400])
def test_suffix_tree_of_frequent_words_and_copies_in_many_parts(spark, monkeypatch, runs):
    """Contexts that lie in several parts, even equal windows, are judged over all of them and kept where a longer one anywhere is."""
    monkeypatch.setattr(suffix_tree, "SLICE_RUNS", runs)
    rng = np.random.default_rng(5)
    rows = [(i, "a b c d e f g h", bool(i % 4 == 0)) for i in range(60)] + [(60 + i, None if i % 2 else "", False) for i in range(30)]
    rows += [(90, "a " * 300, False), (91, "a " * 40, True)]
    for i in range(60):
        tail = [f"w{x}" for x in rng.integers(0, 60, 12)] + ["x", "y", "z"] * int(rng.integers(0, 3))
        parts = [x for w in tail for x in (("the", w) if rng.random() < 0.8 else ("of", "the", w))]
        rows.append((100 + i, " ".join(parts), bool(i % 5 == 0)))
    want, kept = python_tree_scores(rows, 4)
    assert kept > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    got = suffix_tree.score_texts(docs, F.col("held")).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, rel=1e-9)


def test_suffix_tree_needs_little_disk(spark, monkeypatch):
    """The tables written stay below 4.5 bytes a token at any time, and the session's settings are as before."""
    here, most = {}, [0]

    def measured(table, name, stored=suffix_tree.stored):
        found = stored(table, name)
        for file in found.inputFiles():
            here[file.removeprefix("file://")] = None
        most[0] = max(most[0], sum(Path(f).stat().st_size for f in here if Path(f).exists()))
        return found

    monkeypatch.setattr(suffix_tree, "stored", measured)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in (rng.random(10_000) ** 3 * 3000).astype(int))) for i in range(40)]
    got = suffix_tree.score_texts(table(spark, rows), F.col("doc_id") % 7 == 2).collect()
    tokens = sum(r["n_tokens"] for r in got)
    assert tokens == 400_040 and most[0] < 4.5 * tokens, most[0] / tokens
    assert spark.conf.get(key, None) == before


def test_suffix_tree_edges(spark):
    docs = table(spark, EDGES)
    got = suffix_tree.score_texts(docs, F.col("doc_id") == 4).collect()
    assert len(got) == len(EDGES) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    none = suffix_tree.score_texts(docs, F.lit(True)).collect()
    assert {r["n_known"] for r in none} == {0} and {r["base_score"] for r in none} == {0.0}
    assert suffix_tree.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_suffix_tree_rare_runs_stay_in_a_large_corpus(spark):
    """A passage seen three times is learnt beside some 400,000 other tokens as beside none."""
    passage = " ".join(f"rare{i}" for i in range(12))
    rng = np.random.default_rng(3)
    filler = [(i + 10, " ".join(f"w{k}" for k in rng.integers(0, 500, 10_000))) for i in range(40)]
    docs = table(spark, [(i, passage) for i in range(4)] + filler)
    got = suffix_tree.score_texts(docs, F.col("doc_id") == 3).filter("held_out").collect()
    assert len(got) == 1 and got[0]["n_known"] == 13 and got[0]["score"] > got[0]["base_score"] / 2


def test_held_out_labels_change_nothing(spark):
    """Labels of documents outside the training rows, or of none at all, do not change which texts are drawn."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    training = docs.filter("doc_id % 2 = 0")
    few = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    more = few.unionByName(spark.createDataFrame([(i, 1, 1) for i in range(1, 400, 2)] + [(i, 0, 0) for i in range(1000, 3000)], "doc_id long, quality int, toxic int"))
    drawn = [sorted(map(tuple, labelled_sample(training, labels, "toxic", 30, "s").collect())) for labels in (few, more)]
    assert drawn[0] == drawn[1] and 20 < len(drawn[0]) < 100
