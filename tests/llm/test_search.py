"""Operators 3, 5 and 6 against brute force and exact round trips."""

import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import EDGES, table

from dqengine.llm import decontaminate, simhash, text, token_files
from dqengine.llm.elias_fano import EliasFano

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50) | st.lists(st.integers(0, 40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    try:
        code = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    except ValueError:
        return
    assert code.decode().tolist() == values
    assert [code[i] for i in range(len(values))] == values
    assert code.at(np.arange(len(values))).tolist() == values and code.at(np.arange(len(values))[::-3]).tolist() == values[::-3]
    for v in {*values[:5], *values[-5:], 17}:
        assert code.find(v) == sum(x < v for x in values)


def test_elias_fano_is_small():
    places = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    assert len(EliasFano.encode(places).to_bytes()) * 8 / 100_000 < 2 + np.log2(2000) + 0.3
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


PIECES = ["word", "Word", "été", "ÉTÉ", ",", ".", ", ", ". ", ".\n", " ", "  ", "\n", "\t", " ", "×", "don't", "1", "***", "日本", "\x01", "\x02", "<|endoftext|>", "　"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=6))
def test_cut_texts_encode_as_whole_ones(texts):
    encoder = token_files.Encoder(TOKENIZER)
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def python_tokens(rows):
    encode, start, out = token_files._tokenizer(TOKENIZER).encode, 0, []
    for i, t in rows:
        ids = encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()))
    got = token_files.encode_documents(table(spark, rows), TOKENIZER).orderBy("start").collect()
    assert [tuple(r) for r in got] == python_tokens(rows)


def test_token_files_edges(spark, tmp_path):
    rows = [r for r in sorted(EDGES, key=lambda r: (r[0] is None, r[0] or 0))]
    path = str(tmp_path / "files")
    token_files.write_token_files(table(spark, EDGES), path, TOKENIZER)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == python_tokens(rows)
    assert token_files.encode_documents(table(spark, []), TOKENIZER).count() == 0


def test_reading_single_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 300)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + EDGES
    path = str(tmp_path / "files")
    token_files.write_token_files(table(spark, rows), path, TOKENIZER)
    encode = token_files._tokenizer(TOKENIZER).encode
    wanted = [9, 150, -10, 77, 123456]
    got = sorted((r["doc_id"], list(r["ids"])) for r in token_files.read_documents(spark, path, wanted).collect())
    assert got == sorted((i, encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows if i in wanted)


def test_tokenizer_of_another_kind_is_not_cut(tmp_path):
    path = str(tmp_path / "other.json")
    with open(TOKENIZER, encoding="utf-8") as f:
        made = json.load(f)
    made["normalizer"] = {"type": "Lowercase"}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    encoder = token_files.Encoder(path)
    texts = ["Two Words, and more. Yes", None, "A"]
    assert not encoder.cuts and token_files.Encoder(TOKENIZER).cuts
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def python_print(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    rows = [r for r in EDGES if len(r[1] or "") < 10_000] + [(40, "two words"), (41, "Exactly three WORDS"), (42, "four of these words")]
    got = table(spark, rows).select("text", simhash.fingerprint(F.col("text")).alias("p")).collect()
    assert all(r["p"] % 2**64 == python_print(r["text"]) for r in got)


def test_partners_meet_at_the_nearest_anchor():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 200, np.uint64)
    index, anchor, excess = simhash.anchors(prints)
    home = dict(zip(index[excess == 0].tolist(), anchor[excess == 0].tolist()))
    assert len(home) == (excess == 0).sum() == 200  # perfect blocks: one nearest anchor each
    for i, p in enumerate(prints):
        for bits in range(4):
            near = p
            for b in rng.choice(64, bits, replace=False):
                near ^= np.uint64(1) << np.uint64(b)
            assert home[i] in simhash.anchors(np.array([near]))[1]


def python_components(prints, ids):
    prints, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            root[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_print_links_on_a_dense_ball(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64, 4, np.uint64)
    prints = set(rng.integers(0, 2**64, 100, np.uint64).tolist())
    for c in centre:
        for _ in range(150):
            p = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "HOMES", 20)  # crowded anchors are split
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long")
    links = simhash.print_links(frame).collect()
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[find(a % 2**64)] = find(b % 2**64)
    want = python_components(prints, range(len(prints)))
    assert len({find(p) for p in prints}) == len(set(want))


def test_near_duplicates(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(i + 1000, t) for i, t in rows[:20]] + [(2000, None), (2001, ""), (2002, " \n")]
    docs = table(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    want = python_components([python_print(t) for _, t in rows], [i for i, _ in rows])
    assert got == dict(zip([i for i, _ in rows], want))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_edges(spark):
    kept = simhash.keep_one(table(spark, EDGES)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, 4, 5, 7, 8, 9, None, -10], key=str)
    assert simhash.keep_one(table(spark, [])).count() == 0
    assert simhash.near_duplicates(table(spark, [(None, "a b c"), (None, "a b c")])).first()["component_id"] is None


def test_keep_one_keeps_every_component(spark):
    texts = ["the first text has these words", "another one is about something else", "nothing here looks like the others"]
    for ids in ([None, None, None], [7, 7, 7], [7, None, 7]):
        rows = list(zip(ids, texts)) * 2
        kept = simhash.keep_one(table(spark, rows)).select("doc_id", "text").collect()
        assert sorted(map(tuple, kept), key=repr) == sorted(zip(ids, texts), key=repr)
    found = simhash.near_duplicates(table(spark, [(None, t) for t in texts])).collect()
    assert len({r["root"] for r in found}) == 3 and {r["component_id"] for r in found} == {None}


def python_hits(rows, items, window=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    wanted = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wanted:
                    found |= wanted[g]
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_find_items(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    items += [(900, "the"), (901, None), (902, " . "), (903, "word the word"), (904, items[0][1]), (10, "the")]
    rows += EDGES + [(50, items[1][1]), (50, items[1][1]), (51, "x " + items[2][1].upper() + " y"), (52, "the-the,THE")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = decontaminate.find_items(table(spark, rows), asked).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(map(tuple, got), key=repr) == python_hits(rows, items)
    clean = decontaminate.decontaminate(table(spark, rows), asked)
    assert clean.columns == table(spark, []).columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r[0] for r in python_hits(rows, items) if not r[2]), key=str)


def test_items_without_an_id(spark):
    asked = spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (3, "alpha beta")], "item_id long, text string")
    docs = table(spark, [(1, "x alpha beta y"), (2, "gamma delta"), (3, "gamma beta")])
    got = {r["doc_id"]: r for r in decontaminate.find_items(docs, asked).collect()}
    assert {i: (r["n_hit"], r["items"]) for i, r in got.items()} == {1: (2, ["3"]), 2: (2, []), 3: (0, [])}
    assert sorted(map(tuple, got[1]["spans"]), key=repr) == [("3", 1, 2), (None, 1, 2)] and [tuple(s) for s in got[2]["spans"]] == [(None, 0, 1)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, asked).collect()] == [3]


def test_proximity_and_spans(spark):
    item = "alpha beta gamma delta epsilon"
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table(spark, [(1, "x alpha beta gamma delta epsilon y"), (2, "alpha beta new gamma delta epsilon"), (3, "alpha gamma")])
    exact = {r["doc_id"]: r["spans"] for r in decontaminate.find_items(docs, asked).collect()}
    assert [tuple(s) for s in exact[1]] == [("1", 1, 5)] and not exact[2] and not exact[3]
    near = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_items(docs, asked, slack=1).collect()}
    assert near[1] and near[2] and not near[3]
    assert decontaminate.find_items(docs.limit(0), asked).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_items(docs, asked.limit(0)).collect()} == {0}


@pytest.mark.parametrize("slack", [1, 3])
def test_proximity_stays_in_one_document(spark, slack):
    asked = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma"), (2, "delta epsilon y"), (3, ""), (4, "alpha"), (5, "beta gamma delta epsilon"), (6, "alpha beta q gamma delta epsilon")]
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_items(table(spark, rows).coalesce(1), asked, slack=slack).collect()}
    assert {i for i, n in got.items() if n} == {6}


def test_word_hashes_do_not_depend_on_place():
    texts = ["ab cd  ab", None, "", "x" * 5000 + " ab", "cdab ab\tcd"]
    data, offsets = text.string_bytes(pa.array(texts))
    starts, ends, first = text.words(data, offsets, text.BLANKS)
    hashes = text.word_hashes(data, starts, ends)
    seen = {}
    for a, b, h in zip(starts, ends, hashes):
        assert seen.setdefault(bytes(data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen) == 4 and np.diff(first).tolist() == [3, 0, 0, 2, 3]
