import random
import re
import time
from collections import Counter as Tally

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import decontamination as D
from framelake.llm import url_filters as U
from framelake.llm.token_counts import Counter, count_tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counter():
    return Counter("byte_bpe_50k.json")


PIECES = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "<|", "|>", "'s", "1", "23", "é", "ß", "中", "🤦", "\xa0", "\x85", "\x1c", "\u3000", "٣", "ǆ", "\u0301", "!", "..", "\t", "xyz" * 30, " " * 40, "ſ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join), st.sampled_from([(10**6, 9), (60, 8), (97, 40), (300, 33)]))
def test_counts_equal_the_library(counter, text, size):
    assert counter.count(text, *size) == len(counter.tokenizer.encode(text, add_special_tokens=False))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_counts_of_any_text(counter, text):
    text = text.encode("utf-8", "ignore").decode()
    assert counter.count(text) == counter.count(text, 40, 6) == len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_widening_until_alignment(counter):
    for text in ("x" * 5000, " " * 5000 + "x", "ab " * 10 + "y" * 3000 + " z" * 50):
        assert counter.count(text, 64, 8) == len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_token_query(spark, counter, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = Tally()
        for r in docs.collect():
            t = r["text"] or ""
            n = len(counter.tokenizer.encode(t, add_special_tokens=False))
            want[r["doc_id"], len(t.encode()), n, n > 1024] += 1
        assert Tally(map(tuple, count_tokens(docs).collect())) == want
    assert count_tokens(no_docs).count() == 0


def test_masks_miss_no_stretch():
    """Two other words anywhere among 13 leave a window of one of the masks without a difference."""
    for a in range(13):
        for b in range(a + 1, 13):
            assert any(all(m[k] == "0" or s + k not in (a, b) for k in range(len(m))) for m in D.MASKS for s in range(14 - len(m)))


def brute_leaks(docs, items):
    out = set()
    split = lambda t: [w for w in map(D.normal_word, D.split_words(t)) if w]
    for d, text in docs:
        x = split(text)
        for i, item in items:
            y = split(item)
            w = min(13, len(y))
            need = w if len(y) < 13 else 11
            for start in range(-len(y), len(x)):
                same = [0 <= start + k < len(x) and x[start + k] == y[k] for k in range(len(y))]
                if w and any(sum(same[k : k + w]) >= need for k in range(len(y) - w + 1)):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([1, 3, 7, 12, 13, 14, 20, 45])))) for i in range(40)] + [(90, ""), (91, "..."), (92, None)]
    docs = []
    for d in range(120):
        x = text(rng.randint(0, 80))
        if d % 2:
            y = items[rng.randrange(40)][1].split()
            for k in range(rng.randint(0, 4)):
                y[rng.randrange(len(y))] = rng.choice(["other", "W5,", "(w7)"])
            at = rng.randint(0, len(x))
            x[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in y]
        docs.append((d, rng.choice([" ", "\n", "\t"]).join(x)))
    docs += [(200, None), (201, ""), (202, " ".join(text(20_000)))]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, [(i, t or "") for i, t in items])
    assert len(want) > 20
    got = D.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    clean = {r["doc_id"] for r in D.drop_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_in_blocks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "same text here again"), (2, "no such words anywhere"), (None, "two words"), (2, None)], "item_id bigint, text string")
    want = sorted([(None, 1), (3, 1), (4, 1), (4, 1), (5, 1), (9, None)], key=str)
    for size in (500_000, 5):
        monkeypatch.setattr(D, "BLOCK_WORDS", size)
        assert sorted(((r["doc_id"], r["item_id"]) for r in D.find_leaks(odd_docs, bench).collect()), key=str) == want
        assert D.drop_leaks(odd_docs, bench).columns == odd_docs.columns
        assert D.drop_leaks(odd_docs, bench).count() == odd_docs.count() - 6
    assert D.find_leaks(no_docs, bench).count() == 0 and D.find_leaks(odd_docs, bench.limit(0)).count() == 0
    assert D.drop_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_repetitive_texts_equal_brute_force(spark, monkeypatch):
    """Words, pairs and triples over and over, with hits listed, listed item by item, or taken as everywhere."""
    rng = random.Random(7)
    loop = lambda ws, n: " ".join((ws * n)[:n])
    items = [(0, loop(["a"], 40)), (1, loop(["a", "b"], 33)), (2, loop(["a", "b", "c"], 20)), (3, "a a a"), (4, loop(["a"], 15) + " " + loop(["q"], 15)), (5, "a b c d e f g h i j k l m n o p")]
    docs = [(d, " ".join(x for w in range(rng.randint(1, 6)) for x in [loop(rng.choice([["a"], ["a", "b"], ["a", "b", "c"], ["q"], ["z", "a"]]), rng.randint(1, 60))])) for d in range(60)]
    docs += [(90, "x " * 30 + items[5][1]), (91, ""), (92, None)]
    want = brute_leaks([(d, t) for d, t in docs], items)
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    answers = []
    for most, compared in ((1 << 19, 1 << 21), (40, 100), (0, 1 << 21)):
        monkeypatch.setattr(D, "MOST_HITS", max(1, most))
        monkeypatch.setattr(D, "COMPARED", compared)
        index = D.SeedIndex([t for _, t in items])
        answers.append(sorted((docs[r][0], *rest) for r, *rest in index.leaks([t for _, t in docs])))
        assert {(d, i) for d, i, *_ in answers[-1]} == want and len(answers[-1]) == len(want)
    assert answers[0] == answers[1] == answers[2]
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, bench).collect()} == want


def test_very_repetitive_texts_in_bounded_time():
    index = D.SeedIndex(["word " * 10_000, "a b " * 3_000])
    began = time.process_time()
    got = list(index.leaks(["word " * 100_000, "a b " * 20_000]))
    assert [(r, i, s, m) for r, i, s, m, *_ in got] == [(0, 0, 1.0, 10_000), (1, 1, 1.0, 6_000)]
    assert time.process_time() - began < 60


@pytest.mark.parametrize("kind, ids", [("int", [7, None]), ("bigint", [None, 7]), ("string", [None, "b"]), ("decimal(20,0)", [None, 7])])
def test_ids_of_any_type(spark, kind, ids):
    bench = spark.createDataFrame([(str(i) if i is not None else None, t) for i, t in zip(ids, ["one two three", "four five six"])], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "four five six"), (None, "one two three"), ("d2", "none of them")], "doc_id string, text string")
    got = D.find_leaks(docs, bench.withColumn("item_id", bench["item_id"].cast(kind)))
    assert dict(got.dtypes)["item_id"] == kind
    assert {(r["doc_id"], r["item_id"] and str(r["item_id"])) for r in got.collect()} == {("d1", ids[1] and str(ids[1])), (None, ids[0] and str(ids[0]))}


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1000), (50, 20_000), (3000, 3000), (1, 0)):
        h = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        rng.shuffle(h)
        listed, rest = h[:n], h[n:]
        first = U.Bloom.of(listed, min(0.5, n / (1.41 * max(1, len(h)))) if m % 3 else 0.5, 0)
        cascade = U.levels(listed, rest[first.has(rest)], first)
        assert U.is_listed(cascade, listed).all() and not U.is_listed(cascade, rest).any()


RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"), U.Rule("allow", "com", "/fr/"), U.Rule("block", "com", "/de/")]
URLS = [None, "", "example.org/es/", "http://", "http://EXAMPLE.org/es/x", "http://a.b.example.org/es/", "http://notexample.org/es/1", "https://x.org?q=/es/", "https://x.org", "https://x.org#/", "http://example.org/en/12", "http://example.org/en/2",
        "http://example.org/es", "ftp://shop.com/fr/", "http://shop.com/FR/", "http://shop.com:80/de/", "http://com/de/a#b?c", "x://y://example.org/es/", "http://a..com/de/", "http://shop.com/de/?u=http://x.org/", "http://com/" + "d" * 70_000]


def judged(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, tail = rest[:n].lower(), rest[n:]
        path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls_equal_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://example.org/es/", None, None), (3, "http://", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = Tally(map(tuple, U.judge(pages, RULES).collect()))
    assert got == Tally((p, *judged(u)) for p, u, *_ in rows)
    assert U.judge(pages.limit(0), RULES).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.org/es/x"), (2, "http://" + "." * 100_000 + "/de/"), (3, "http://x.com" + "/fr" * 50_000)], "page_id bigint, url string")
    began = time.time()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(long, RULES).collect()} == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("com/fr/", "allow")}
    assert time.time() - began < 30
    assert {r["verdict"] for r in U.judge(pages, []).collect()} == {"allow"}


def test_repeated_items_are_looked_for_once(spark, monkeypatch):
    """An item that is most of the benchmark stands once in its block; its hits are as many as its rows."""
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words[:20])
    bench = spark.createDataFrame([("a", item)] * 50 + [("b", item)] * 3 + [("c", " ".join(words[20:])), (None, item), ("d", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "nothing"), (3, " ".join(words[20:]))], "doc_id bigint, text string")
    for copies, block in ((4096, 500_000), (7, 30)):
        monkeypatch.setattr(D, "COPIES", copies)
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        got = Tally((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect())
        assert got == {(1, "a"): 50, (1, "b"): 3, (1, None): 1, (3, "c"): 1}
        assert [r["doc_id"] for r in D.drop_leaks(docs, bench).collect()] == [2]
    assert sum(len(texts) for _, texts, _ in D._blocks(bench)) == 4


@pytest.mark.parametrize("word", ["a" + "." * 1_000_000 + "b", "." * 1_000_000, "a" + "." * 1_000_000, "_" * 1_000_000 + "a", "a-" * 500_000])
def test_one_very_long_word_takes_linear_time(word):
    index = D.SeedIndex([" ".join(f"w{i}" for i in range(20))])
    began = time.process_time()
    assert [r for r, *_ in index.leaks([f"{word} " + " ".join(f"(w{i})" for i in range(20)) + " " + word])] == [0]
    assert time.process_time() - began < 5


def test_edges_are_those_of_the_pattern():
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("aB1_-.é中²\u0301\u200d🤦١") for _ in range(rng.randrange(8)))
        assert D.normal_word(word) == re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())
