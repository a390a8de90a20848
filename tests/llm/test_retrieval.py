"""Operators 11, 12 and 13 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import CLASHES, EDGES, table

from dqengine.llm import hard_negatives, html_text, lexical, queries

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def rank_all(docs, items, k):
    """Every document scored for every item, as the contract says."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = 0
            for t in wanted & set(c):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "word the TEXT"), (2, None), (3, "nowhere-found"), (4, "one line of text here"), (4, "nobody"), (None, "text"), (5, "")]


@pytest.mark.parametrize("first", [1, 4, 1000])
def test_search_ranks_as_all_pairs(spark, monkeypatch, first):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 3)
    monkeypatch.setattr(lexical, "CELLS", 40)
    draw = random.Random(3)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    many = [(100 + i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 3, 8, 40])))) for i in range(250)]
    docs = EDGES + many + [(900 + i % 40, "w1 w2 w3 w1 same text") for i in range(80)]
    items = ITEMS + [(50 + i, " ".join(draw.choices(vocabulary, k=6))) for i in range(12)]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    index = lexical.build_index(table(spark, docs).repartition(3))
    got = lexical.search(index, frame, k=5, first=first)
    assert sorted(map(tuple, got.collect()), key=repr) == rank_all(docs, items, 5)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, " .,")], "doc_id long, text string")
    some = spark.createDataFrame(EDGES, "doc_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(blank), items).count() == 0
    assert lexical.search(lexical.build_index(some), items.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "red fish"), ("a", "red fish"), ("c", "blue")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "red")], "item_id string, text string")
    got = lexical.search(lexical.build_index(docs), items).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("q", 1, "a"), ("q", 2, "b")]


def mine_all(rows, is_anchor, k, n):
    """All pairs, as the contract says."""
    good = [(i, lab, np.floor(256 * np.array(v, float)).astype(int)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in good if is_anchor(i)}
    out = []
    for i, lab, v in anchors:
        scored = [(-int(np.dot(v, w)), j, other == lab) for j, other, w in good]
        positives = sorted(s for s in scored if s[2] and s[1] != i)[:k]
        for p in positives:
            fit = sorted(s for s in scored if not s[2] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0])[:n]
            out += [(i, p[1], r + 1, s[1], -p[0], -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("first", [1, 100, 4096])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, first):
    for name, value in (("CELL_ROWS", 20), ("BLOCK_ROWS", 16), ("BATCH", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((6, 8))
    rows = []
    for i in range(600):
        label = int(draw.integers(4))
        v = centres[draw.integers(6)] + draw.standard_normal(8) * 0.4
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label))
    # a third holds one vector; some rows take no part
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(300)]
    rows += [(2000, None, 1), (2050, [1.0, None, *[0.0] * 6], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 2)]
    rows += [(2200, rows[5][1], None), (None, rows[5][1], 1), (2250, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in CLASHES if c != "label"})
    got = hard_negatives.mine(frame.repartition(3), F.col("vec_id") % 50 == 0, first=first)
    assert sorted(map(tuple, got.collect())) == mine_all(rows, lambda i: i % 50 == 0, 5, 3)


def test_negatives_edges(spark):
    def mined(rows):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        return sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") == 0).collect()))

    assert mined([]) == []
    assert mined([(0, [1.0], 1)]) == []
    # a repeated anchor is one anchor; other lengths than the commonest take no part; opposite vectors have no window
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (3, [0.75, 9.0], 3), (4, [1.0], 2), (5, [-1.0, 0.0], 1)]
    assert mined(rows) == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 3, 65536, 49152)]
    # whole numbers beyond single precision stay exact
    big = [(0, [4000.0] * 8, 1), (1, [4000.0] * 8, 1), (2, [3000.0] * 7 + [3000.01], 2)]
    score = sum(1024000 * x for x in [768000] * 7 + [math.floor(256 * float(np.float32(3000.01)))])
    assert mined(big) == [(0, 1, 1, 2, 8 * 1024000**2, score)]


def test_negatives_send_no_table_of_the_anchors_through_the_driver(spark, monkeypatch):
    plans, write = {}, hard_negatives.stored

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(hard_negatives, "stored", kept)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 62))  # whatever may be broadcast is
    try:
        got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0)
        plans["result"] = [got._jdf.queryExecution().executedPlan().toString()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    grown = ["calls", "early", "late", "negatives", "floors", "asked", "windows", "last", "result"]
    assert not [name for name in grown for p in plans[name] if "BroadcastExchange" in p]
    assert all("RepartitionByNum" in p or "REPARTITION_BY_NUM" in p for p in plans["calls"])  # visits are many tasks


def test_bounds_cover_every_row():
    draw = np.random.default_rng(1)
    v = draw.integers(-100, 100, (300, 6)).astype(float)
    books = hard_negatives._means(v[:50, :3], 4), hard_negatives._means(v[:50, 3:], 4)
    near1, far1 = hard_negatives._nearest(v[:, :3], books[0])
    near2, far2 = hard_negatives._nearest(v[:, 3:], books[1])
    cell = near1 * 4 + near2
    cells = np.zeros((16, 3))
    for c in range(16):
        if (cell == c).any():
            cells[c] = (cell == c).sum(), far1[cell == c].max(), far2[cell == c].max()
    q = draw.integers(-100, 100, 6).astype(float)
    order = list(hard_negatives._sequence((books, cells), q))
    assert sorted(c for _, c in order) == list(range(16))
    assert all(a[0] >= b[0] for a, b in zip(order, order[1:]))
    for bound, c in order:
        assert not (cell == c).any() or (v[cell == c] @ q).max() <= bound + 1e-6


HTML = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="Home page">
<nav><ul><li><a href="/a">One</a><li><a href='/b>c'>Two &amp; three</a></ul></nav><!-- <p>gone</p> -->
<script>var t="</p>"; if (1 < 2) {}</script><article id=top><h1>Title&nbsp;here</h1><p>First  <b>bold</b>
line<br>more<p>Second &lt;tag&gt; &copy 5 < 6<div>Third</div>tail</article><footer>End &amp; out"""


def test_blocks_of_a_page():
    blocks = html_text.leaf_blocks(HTML)
    assert [b[1] for b in blocks] == ["One", "Two & three", "Title here", "First bold line more", "Second <tag> © 5 < 6", "Third", "tail", "End & out"]
    assert blocks[0][0] == ("html", "body", "home", "page", "nav", "ul", "li") and blocks[0][2] == 1.0
    assert blocks[3][0] == ("html", "body", "home", "page", "article", "top", "p") and blocks[3][2] == 0.0
    assert blocks[-1][0][-1] == "footer"
    assert html_text.leaf_blocks("") == [] and html_text.leaf_blocks("<p>a<script>never closed") == [(("p",), "a", 0.0)]
    assert [b[1] for b in html_text.leaf_blocks("plain text &am")] == ["plain text &am"]


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(4)
    pages = []
    for n in (1, 4, 6):
        paths = [("body", "p") if i % 2 else ("nav",) for i in range(n)]
        pages.append((paths, draw.standard_normal((n, html_text.WIDTH - html_text.PATH)).astype(np.float32), np.arange(n) % 2.0))
    flat = draw.standard_normal(sum(int(np.prod(s)) for s in html_text._shapes())) * 0.2
    bounds = np.array([0, 1, 5, 11])
    x = np.concatenate([np.concatenate([html_text.path_vectors(p), v], 1) for p, v, _ in pages]).astype(float)
    y = np.concatenate([p[2] for p in pages])

    def loss(weights):
        p = html_text.BlockModel(weights).score(x, bounds)
        return -(np.repeat(1 / np.diff(bounds), np.diff(bounds)) * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    slope = html_text._slope(flat, pages)
    for j in draw.integers(len(flat), size=25):
        step = np.zeros(len(flat))
        step[j] = 1e-2  # the scores are single precision
        assert slope[j] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-2, abs=2e-4)


def test_order_of_pages_does_not_matter():
    draw = np.random.default_rng(5)
    model = html_text.BlockModel(draw.standard_normal(sum(int(np.prod(s)) for s in html_text._shapes())) * 0.2)
    sizes = [3, 0, 50, 7, 1]
    x = draw.standard_normal((sum(sizes), html_text.WIDTH)).astype(np.float32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    whole = model.score(x, bounds)
    for a, b in zip(bounds, bounds[1:]):
        assert np.allclose(model.score(x[a:b], np.array([0, b - a])), whole[a:b], atol=1e-5)


def test_main_text(spark):
    """Learnt on one half of the pages: the other half's articles come whole, and so does other markup."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_text.train(pages.filter("page_id % 2 = 0"), sample=100, steps=250)
    wanted = {}
    for r in pages.filter("page_id % 2 = 1").collect():
        wanted[r["page_id"]] = "\n\n".join(b[1] for b in html_text.leaf_blocks(r["html"]) if html_text.marked(b[0]))
    kept = html_text.extract(pages.filter("page_id % 2 = 1"), model).collect()
    assert sum(wanted[r["page_id"]] == r["main_text"] for r in kept) >= 0.98 * len(wanted)
    other = pages.filter("page_id % 2 = 1").withColumn("html", F.regexp_replace("html", "<(/?)article>", '<$1div class="post-content">'))
    other = other.withColumn("html", F.regexp_replace("html", "<footer>", '<div class="comments"><p>Nice one, thanks for this.</p></div><footer>'))
    other = other.withColumn("html", F.regexp_replace("html", "</div class=.post-content.>", "</div>"))
    assert sum(wanted[r["page_id"]] == r["main_text"] for r in html_text.extract(other, model).collect()) >= 0.9 * len(wanted)


def test_main_text_edges(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "no markup at all", "u"), (None, HTML, None), (4, HTML, "u"), (4, HTML, "u"), (5, "<p>" + "long words " * 200_000, "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumns({c: F.lit("x") for c in [*CLASHES, "blocks", "main_text", "draw"]})
    for sample in (pages, pages.limit(0), pages.filter("page_id = 3")):
        model = html_text.train(sample, sample=10, steps=20)
        got = html_text.extract(pages, model).collect()
        assert len(got) == len(rows) and set(got[0].asDict()) == set(pages.columns)
        assert all(r["main_text"] == "" for r in got if r["page_id"] in (1, 2))
    # without a marked page every block is text, however long
    assert {len(r["main_text"]) for r in got if r["page_id"] == 5} == {len("long words " * 200_000) - 1}
    assert html_text.extract(pages.limit(0), model).count() == 0


def test_query_columns(spark):
    assert dict(queries.QUERIES["op13_html_text"](spark, FOLDER).dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
