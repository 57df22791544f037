import glob
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.llm import context_hashing as ch
from framelake.llm import filter_audit, queries, spelling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_spelling_variants"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def plain_audit(docs, labels):
    """Every order applied document by document."""
    said = defaultdict(set)
    for doc_id, quality, toxic in labels:
        said[doc_id] |= ({"good"} if quality == 1 else set()) | ({"toxic"} if toxic == 1 else set())
    rows = []
    for r in docs:
        t = r["text"] or ""
        words = [w.decode() for w in t.encode().split()]
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        if r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == t for o in docs):
            fails.add("E")
        rows.append((r["source"] or "", fails, said[r["doc_id"]] if r["doc_id"] is not None else set()))
    out = {}
    for part in {p for p, _, _ in rows}:
        mine, sums, at = [(f, s) for p, f, s in rows if p == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [s for f, s in left if x in f]
                left = [(f, s) for f, s in left if x not in f]
                fine, bad = (sum(w in s for s in gone) for w in ("good", "toxic"))
                sums[x] += len(gone)
                at.append((order, step, x, len(left), len(gone), sum(x in f for f, _ in mine) - len(gone), sum(f == {x} for f, _ in mine), fine, bad))
        out |= {(part, o, k): (*rest, sums[x]) for o, k, x, *rest in at}
    return out


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    said = [(1, 1, 0), (3, 0, 1), (4, 1, None), (4, 0, 1), (None, 1, 1), (9, 1, 0), (6, None, None)]
    labels = spark.createDataFrame(said, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(odd_docs, labels).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in got} == plain_audit(odd_docs.collect(), said)
    assert len(got) == 600 * len({r["part"] for r in got})
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(odd_docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_crowded_texts_and_ids(spark):
    rows = [(i if i % 3 else 7, "same" if i % 2 else f"text {i}", "a" if i % 5 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = filter_audit.audit(docs, spark.createDataFrame([(7, 1, 1)], "doc_id bigint, quality int, toxic int"))
    step = got.where("filter_order = 'EABCD' and step = 1").agg(F.sum("removed"), F.sum("good_lost")).first()
    least = min(i for i, t, _ in rows if t == "same")
    want = [i for i, t, _ in rows if t == "same" and i > least]
    assert tuple(step) == (len(want), want.count(7))


def test_potentials_give_shapley_values(spark):
    rng = random.Random(3)
    counts = [rng.randrange(50) for _ in range(8)]
    df = spark.createDataFrame([(counts,)], "c array<bigint>")
    game = filter_audit.removal_game(F.col("c"), 3)
    v, p = df.select(game, filter_audit.potentials(game, 3)).first()
    assert v == [sum(n for m, n in enumerate(counts) if m & s) for s in range(8)]
    for i in range(3):
        total = 0
        for order in itertools.permutations(range(3)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += v[before | 1 << i] - v[before]
        assert p[7] - 3 * p[7 - (1 << i)] == total


def plain_words(rows):
    found = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            k = h % len(run)
            found[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(5)
    letters = "abcdéþ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "ababab", "abababa", "a" * 3000, "a" * 3001]
    words = []
    for w in bases:
        words += [w.upper()] * rng.randrange(3, 40)
        for _ in range(6):
            k, v = rng.randrange(len(w)), w
            v = rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice(letters) + v[k:], v[:k] + rng.choice(letters) + v[k + 1 :]])
            words += [v] * rng.randrange(3, 12)
    rng.shuffle(words)
    more = spark.createDataFrame([(i % 7 if i % 5 else None, " ".join(words[i::40])) for i in range(40)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").union(more).withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit("k")})
    want = plain_variants(plain_words(docs.collect()))
    got = spelling.group_variants(docs).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert any(v[0] and v[1] != v[0] for v in want.values()) and spelling.group_variants(no_docs).count() == 0


def test_tables_that_grow_with_the_words_are_not_broadcast(spark, monkeypatch):
    """However small Spark takes them to be: none of the plans, those of the tables in between too, has a broadcast."""
    plans, write = [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, name: (write(df, name), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = spelling.group_variants(spark.read.parquet(f"{SF}/documents.parquet"))
        assert out.count()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 9)))
        grams = [(p, rng.randrange(20)) for p in places]
        a, b = spelling.choose_pivots(grams)
        cost = dict(grams)
        assert b - a >= 2 and cost[a] + cost[b] == min(cost[x] + cost[y] for x in places for y in places if y - x >= 2)


def plain_fingerprint(text):
    """Byte by byte, trying every level from the least."""
    data, hashes, window = text.encode(), [], [0] * ch.WINDOW
    for b in data:
        window = [b, *window[:-1]]
        h = sum(c * pow(ch.BASE, j + 1) for j, c in enumerate(window)) & 0xFFFFFFFF
        h ^= h >> 16
        h = h * ch.MIX & 0xFFFFFFFF
        hashes.append(h ^ h >> 13)

    def ends(level):
        found = [i + 1 for i, h in enumerate(hashes) if level <= 32 and h % (1 << level) == 0]
        return found if found[-1:] == [len(data)] else [*found, len(data)]

    def signature(cuts):
        crcs = [zlib.crc32(data[a:b]) % 4096 for a, b in zip([0, *cuts], cuts)]
        return "".join(ch.DIGITS[c // 64] + ch.DIGITS[c % 64] for c in crcs)

    level = next((k for k in range(2, 34) if len(ends(k)) <= 128), 33)
    return ":".join([str(level), *[signature(ends(level + k)) for k in range(3)]]) if data else "0:::"


def test_fingerprints_equal_a_plain_version():
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    texts = ["", "a", "ab", "中文 🤦", "x" * 5000, "ab" * 40_000, "line of text\n" * 9000, *[prose(n) for n in (1, 3, 10, 40, 100, 300, 1000, 5000, 30_000)], prose(2000) + "\0" * 90_000]
    for t in texts:
        assert ch.fingerprint(t) == plain_fingerprint(t)
        assert len(ch.fingerprint(t)) <= 2 * 3 * ch.PIECES + 8


def test_edit_distance_and_likeness():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 129))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        assert ch._edits(a, b) == row[-1]
    assert ch.likeness("0:::", "0:::") == 1 and ch.likeness("0:::", "3:AA:AA:AA") == 0 and ch.likeness("3:AABB:AA:AA", "6:AABB:AA:AA") == 0
    assert ch.likeness("3:AABB:AACC:EE", "4:AADD:AA:FF") == 0.5 == ch.likeness("4:AADD:AA:FF", "3:AABB:AACC:EE")
    assert ch.likeness("3:AABB:AACC:EEFF", "5:EEGGHHII:AA:FF") == 0.25 == ch.likeness("5:EEGGHHII:AA:FF", "3:AABB:AACC:EEFF")


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def plain_neighbours(rows):
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        fp, new_fp, after_fp = map(plain_fingerprint, (text, new, after))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fp, new_fp, ch.likeness(fp, new_fp), ch.likeness(fp, after_fp)))
    return out


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_neighbours(spark, no_docs, ranges):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(rng.choice(["alpha", "beta", "γάμμα", "delta", "", "long" * 9]) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    rows[7] = (21, rows[6][1])
    rows[9] = (27, None)
    docs = spark.createDataFrame(random.Random(7).sample(rows, 60), "doc_id bigint, text string").withColumns({"part": F.lit(1), "seam": F.lit("tail"), "fingerprint": F.lit(0)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", ranges < 37)
    try:
        got = sorted(map(tuple, ch.compare_neighbours(docs).collect()))
        assert got == plain_neighbours([(i, t or "") for i, t in rows])
        assert ch.compare_neighbours(no_docs).count() == 0
        assert tuple(ch.compare_neighbours(docs.where("doc_id = 3")).first()) == plain_neighbours([rows[1]])[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_neighbours_of_odd_rows(spark, odd_docs):
    got = ch.compare_neighbours(odd_docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in got) == Counter((r["doc_id"], len(r["text"] or ""), plain_fingerprint(r["text"] or "")) for r in odd_docs.collect())
    assert odd_docs.schema["doc_id"].dataType == ch.compare_neighbours(odd_docs).schema["doc_id"].dataType


def test_edits_are_seen_and_strangers_are_not(spark):
    rows = ch.compare_neighbours(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    long = [r for r in rows if r["n_chars"] > 300]
    assert sum(r["near_edited"] >= 0.25 for r in long) > 0.98 * len(long)
    assert sum(r["near_next"] > 0.2 for r in long) < 0.1 * len(long)
