import html
import random
import re
import time
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import html_extraction as H
from framelake.llm import nearest as N
from framelake.llm.html_blocks import blocks
from framelake.llm.html_training import labelled_pages

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model():
    return H.trained_model()


def test_held_out_layouts(model):
    right = total = 0
    for page in labelled_pages(150, seed=77):
        x, y = H.labelled_blocks(page)
        right += sum(a == b for a, b in zip(y, model.decode(x)))
        total += len(y)
    assert right / total > 0.99


def test_pages_of_the_table(spark, model):
    """These pages hold their main text in an article element; the model isn't told."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages, model).collect()}
    good = 0
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        good += got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]
    assert good / len(got) > 0.99


def test_blocks_of_malformed_markup():
    page = "<div>a &amp; b<p>c<b>d<p>e<br>f <i>g</i>h</div><script>if (a<b) '</p>'</script><style>x</style><!-- <p>no --><ul><li>i<li>j</ul>k<table><tr><td>l<td>m</table><textarea>n <b></textarea><p hidden>o</p><p style='display: none'>p</p>&nbsp;q&#x41;"
    assert [b.text for b in blocks(page)] == ["a & b", "cd", "e f gh", "i", "j", "k", "l", "m", "n <b>", "qA"]
    assert blocks("<p>x<")[0].text == "x<" and blocks("<script>never closed") == [] and blocks("") == [] == blocks(None)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article title="The hidden truth"><p>Hello world</p></article>', ["Hello world"]),
        ('<main data-hidden="false"><p>Hello world</p></main>', ["Hello world"]),
        ('<div aria-label="hidden gems">Hello world</div>', ["Hello world"]),
        ("<p data-style='display:none' xhidden hiddenx>Hello</p>", ["Hello"]),
        ("<p title='a\"hidden' alt=hidden class = \"x hidden\">Hello</p>", ["Hello"]),
        ("<p aria-hidden=false>Hello</p><p aria-hidden='true'>no</p><p ARIA-HIDDEN = TRUE>no</p>", ["Hello"]),
        ("<p hidden>no</p><p HIDDEN=''>no</p><p hidden=until-found>no</p><p/hidden>no</p><p style=display:none>no</p><p STYLE='color: red; Visibility : Hidden'>no</p>", []),
        ("<p>Main text here <span hidden>x<p>Next", ["Main text here", "Next"]),
        ('<p>intro <span style="display:none">x<div>more</div>', ["intro", "more"]),
        ('<p>foo<span style="display:none">SECRET</span>y</p>', ["fooy"]),
        ("<p>a <noscript>no</noscript>b <svg><text>no</text></svg>c <object>no</object>d <template>no</template>e</p>", ["a b c d e"]),
        ("<p>Let <math><mi>x</mi><annotation>no</annotation></math> be</p>", ["Let x be"]),
        ("<div hidden><p>no<div>no</div>no</div>yes<div hidden>no</div><p>yes</p>", ["yes", "yes"]),
        ("<p>one<br hidden>two</p>", ["one two"]),
    ],
)
def test_what_is_hidden_is_left_out_by_the_piece(page, want):
    assert [b.text for b in blocks(page)] == want


def test_marks_come_from_their_own_attributes():
    found = blocks('<div data-role="menu" title="class=advert id=nav" class="Story-Body big" id=main role=\'article\' itemprop="text"><p>x')
    assert found[0].marks == {"story", "body", "big", "main", "article", "text"}


def test_head_that_is_not_closed(model):
    body = "".join(p for p, _ in labelled_pages(1, seed=5)[0])
    assert [b.text for b in blocks("<html><head><title>t</title><meta charset=x><link rel=y><body><p>one<p>two")] == ["one", "two"]
    assert [b.text for b in blocks("<head><style>x</style><noscript><img src=a></noscript><div>one</div>")] == ["one"]
    assert [b.text for b in blocks("<head><title>t</title>text at once<p>two")] == ["text at once", "two"]
    assert H.main_text(body.replace("</head>", ""), model) == H.main_text(body, model)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<a " * 350_000, 1),
        ("<div>x" * 100_000, 100_000),
        ("".join(f"<div class=c{'abcdefghij'[i % 10]}{chr(97 + i % 26)}x>y" for i in range(60_000)), 60_000),
        ('<p>one</p>' + '<a " > "' * 100_000, 1),
        ("<script>" + "</script " * 100_000, 0),
        ("<li><ul>" + "<b>" * 50_000 + "<li>z</li>" * 50_000, 50_000),
        ("</x>" * 100_000 + "<b>" * 100_000 + "</i>" * 100_000 + "end", 1),
        ("<!--" * 200_000 + "x", 0),
        ("&amp;" * 200_000, 1),
        ("<p " + "a" * 1_000_000 + ">x", 1),
        ("<p " + "a " * 300_000 + "hidden>x", 0),
        ("<p " + "a =" * 300_000 + ">x", 1),
        ("<p a" + " " * 1_000_000 + "b>x", 1),
        ("<p " + "a='" * 300_000 + ">x", 1),
    ],
)
def test_long_odd_pages_take_linear_time(model, page, want):
    began = time.process_time()
    found = blocks(page, model.known)
    assert abs(len(found) - want) <= 1
    model.decode(H.features(found))
    assert time.process_time() - began < 15


def test_viterbi_is_the_best_path(model):
    rng = random.Random(1)
    for _ in range(20):
        x, _y = H.labelled_blocks(labelled_pages(1, seed=rng.randrange(10**6))[0])
        x = x[:9]

        def score(labels):
            s = model.begin[labels[0]] + sum(sum(model.weights.get(f, 0.0) for f in fs) for fs, y in zip(x, labels) if y)
            return s + sum(model.turn[a, b] for a, b in zip(labels, labels[1:]))

        best = max(score([k >> i & 1 for i in range(len(x))]) for k in range(1 << len(x)))
        assert score(model.decode(x)) == pytest.approx(best)


def test_odd_pages(spark, model):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, None, "no markup at all", "x"), (3, "u", "<html>" + "<article><p>" + "Long text, with words. " * 40_000 + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract(pages, model).collect()
    assert len(got) == 5 and {r["page_id"]: r["n_chars"] for r in got}[3] == len("Long text, with words. " * 40_000) - 1
    assert [r["text"] for r in got if r["page_id"] == 1] == ["", ""]
    assert H.extract(pages.limit(0), model).count() == 0


def brute(rows, k=5, every=50):
    """Of every query row, in order, its nearest."""
    out = {}
    for a, (i, q) in enumerate(rows):
        if i % every == 0:
            q = np.array(q)
            score = [(-float((q * np.array(v)).sum() / (np.sqrt((q**2).sum()) * np.sqrt((np.array(v) ** 2).sum()))), j) for b, (j, v) in enumerate(rows) if a != b and len(v) == len(q)]
            out.setdefault(i, []).append([(j, -s) for s, j in sorted((round(s, 13), j) for s, j in score)[:k]])
    return out


def found(df):
    """By query_id and rank, the answers of its rows."""
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return out


def same(got, want):
    ranks = lambda lists: {n + 1: [x[n] for x in lists if len(x) > n] for n in range(max(map(len, lists), default=0))}
    want = {q: ranks(lists) for q, lists in want.items() if any(lists)}
    rounded = lambda pairs: sorted((j, round(s, 9)) for j, s in pairs)
    return got.keys() == want.keys() and all({n: rounded(x) for n, x in got[q].items()} == {n: rounded(x) for n, x in want[q].items()} for q in want)


def recall(spark, table):
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    hit = total = 0
    for q, ranks in found(N.search(table)).items():
        s = u @ u[np.flatnonzero(ids == q)[0]]
        s[np.flatnonzero(ids == q)[0]] = -2
        last = np.sort(s)[-5] - 1e-9
        hit += sum(score >= last for n in ranks for _, score in ranks[n])
        total += 5
    assert total == 5 * (ids % 50 == 0).sum()
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    assert recall(spark, spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")) >= 0.9


@pytest.mark.parametrize("make", ["clustered", "scattered", "hot"])
def test_recall_on_other_tables(spark, make):
    """Tables of which a query sees a part alone: clusters, no structure at all, and a vector that a third of the rows share."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(7000, 16))
    if make == "clustered":
        x = rng.normal(size=(60, 16))[rng.integers(0, 60, 7000)] + 0.1 * x
    if make == "hot":
        x[: 7000 // 3] = x[0]
    table = spark.createDataFrame([(int(i), v) for i, v in enumerate(np.float32(x).tolist())], "vec_id bigint, embedding array<float>")
    assert recall(spark, table) >= 0.9


def test_small_tables_are_exact_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), [float(v) for v in np.float32(rng.normal(size=6))]) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.0, -1.0, 0.5, 3.0]) for i in range(40)]
    good += good[:10] + [(50, good[50][1])] * 9 + [(50, good[3][1]), (100, good[4][1])]  # repeated rows, and other vectors under an id
    good += [(i, [float(v) for v in np.float32(rng.normal(size=3))]) for i in range(40, 60)] + [(700, [1.0, 2.0])]  # of other lengths
    bad = [(200, None), (250, [0.0] * 6), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (350, [float("nan")] * 6), (400, [float("inf")] + [1.0] * 5), (450, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id bigint, embedding array<float>, code int, cell string")
    assert same(found(N.search(df)), brute(good))
    assert N.search(df.limit(0)).count() == 0 == N.search(spark.createDataFrame(bad, "vec_id bigint, embedding array<float>").where("vec_id < 500")).count()
    assert found(N.search(spark.createDataFrame(good[:3], "vec_id bigint, embedding array<float>"))).keys() == {0}


def test_crowded_cells_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "QUERY_CHUNK", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=4))]) for i in range(400)]
    assert same(found(N.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))), brute(rows))


def test_queries_are_not_broadcast_however_small_their_file(spark, monkeypatch):
    """Exploded to the rows of entries that they visit, they are many times their file. The sample is the same, read whole or not."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=4))]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(N, "BLOCK", 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = N.search(table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [group#" in plan and "rights" not in plan
        assert same(found(out), brute(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(N, "SAMPLE", 50)
    entries = N.usable(table)
    assert [r["vec_id"] for r in N._sample(entries, 400).collect()] == [r["vec_id"] for r in N._sample(entries, 0).collect()]
    assert N._sample(table.select(F.lit(7).alias("vec_id"), F.col("vec_id").alias("code")), 400).count() == 50


def test_entries_are_dealt_to_rows_of_bounded_size():
    assert N.deal([5, 5, 7, 0, 25, 3, 10, 0], 10) == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 3), (5, 1), (6, 1), (6, 1)] and N.deal([0, 3], 10) == [(0, 1), (0, 1)]
    x = np.random.default_rng(1).normal(size=(3000, 8))
    index = N.MultiIndex(x[:30, :4], x[30:60, 4:])
    assert (index.cells(x) == N.distances(N.scaled(x)[:, :4], index.left).argmin(1) * 30 + N.distances(N.scaled(x)[:, 4:], index.right).argmin(1)).all()
    # What is visited by the distance is what the heap meets.
    index.counts = np.bincount(index.cells(x), minlength=900)
    cells = np.flatnonzero(index.counts)
    for r, (reach, lefts) in enumerate(index.visit(x[:20], 500)):
        met = cells[index.reached(x[r : r + 1], np.array([reach]), cells)[0]]
        assert set((met // 30).tolist()) == lefts and 0 <= index.counts[met].sum() - 500 < index.counts.max()


def test_components_of_extreme_size(spark):
    """Squares of components over- or underflow; the cosine doesn't."""
    rows = [(0, [1e-200, 2e-200, 0.0, 0.0]), (1, [1e200, 2e200, 0.0, 0.0]), (2, [2e-300, 1e-300, 0.0, 0.0]), (3, [0.0, 0.0, 1e308, 1e308]), (4, [5e-324, 1e-323, 0.0, 0.0]), (50, [1.5e308, -1e308, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in N.search(table).collect()}

    def cosine(a, b):
        a, b = ([Fraction(x) for x in v] for v in (a, b))
        dot = sum(x * y for x, y in zip(a, b))
        return float((1 if dot >= 0 else -1) * (Decimal((dot * dot).numerator * (sum(x * x for x in a) * sum(x * x for x in b)).denominator) / Decimal((dot * dot).denominator * (sum(x * x for x in a) * sum(x * x for x in b)).numerator)).sqrt())

    by = dict(rows)
    assert len(got) == 10 and all(s == pytest.approx(cosine(by[q], by[v]), abs=1e-15) for (q, v), s in got.items())


def test_scaling_changes_no_ordinary_score():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 500, 64))
    assert (N.cosines(a, b) == (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))).all()
