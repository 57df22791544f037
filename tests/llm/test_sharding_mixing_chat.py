import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from framelake.llm import chat, mixing, sharding

SF = "/root/testdata/sf0.001"


def test_shards_follow_the_key(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 40).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    slots, places = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        places[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in places.values())
    assert sharding.shard_documents(no_docs, 40).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r["doc_id"]: r for r in sharding.shard_documents(docs, 40).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 41).collect()}
    assert {d: r["grown_shard"] for d, r in a.items()} == b
    moved = sum(b[d] != r["shard"] for d, r in a.items())
    assert 50 <= moved <= 160  # 4000 / 41 is 98
    assert max(Counter(b.values()).values()) < 150


def test_weights_and_a_hot_key(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(docs, 3, [1.0, 1.0, 2.0]).collect()
    hot = {r["shard"] for r in rows if r["doc_id"] == 7}
    assert len(rows) == 3000 and len(hot) == 1
    n = Counter(r["shard"] for r in rows if r["doc_id"] != 7)
    assert 0.44 < n[2] / 2000 < 0.56
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def water(sizes, weights, budget, most):
    """Clamp and share again until nothing is above its cap."""
    total, clamped = budget * sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in clamped)
        free = sum(w for i, w in enumerate(weights) if i not in clamped)
        over = {i for i, w in enumerate(weights) if i not in clamped and w * left / free > most * sizes[i]}
        if not over:
            return [most * s if i in clamped else weights[i] * left / free for i, s in enumerate(sizes)]
        clamped |= over


def test_mix_meets_targets(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lambda t: len((t or "").encode().split())
    for table in (docs, odd_docs):
        rows, got = table.collect(), mixing.mix(table).collect()
        assert Counter((r["doc_id"], words(r["text"])) for r in rows) == Counter((r["doc_id"], r["size"]) for r in got)
        sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
        sizes = [sum(words(r["text"]) for r in rows if r["source"] == s) for s in sources]
        want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2.0)
        target = {}
        for r in got:
            target[r["source_size"], round(r["target"], 6)] = target.get((r["source_size"], round(r["target"], 6)), 0) + r["taken"]
            assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        assert {(s, round(t, 6)) for s, t in zip(sizes, want)} >= set(target)
    assert mixing.mix(no_docs).count() == 0
    mixed = Counter(r["doc_id"] for r in mixing.mix_rows(docs).collect())
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"] // max(1, r["size"])
    assert sum(mixed.values()) == sum(taken.values()) or abs(sum(mixed.values()) - sum(taken.values())) < 0.05 * sum(taken.values())
    assert mixing.mix_rows(odd_docs).columns == odd_docs.columns


def test_taken_words_come_near_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 7, F.lit(3))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 23).cast("int")).alias("text"))
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 4 and all(abs(r["taken"] - r["target"]) <= 23 for r in got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_null_and_repeated_ids_meet_targets(spark):
    """One source of rows without ids, one of a single repeated row, one of one id with many texts."""
    rows = [(None, "a", f"w{i} b c d") for i in range(1000)] + [(7, "b", "one two three")] * 700 + [(8, "c", f"x{i} y") for i in range(900)] + [(None, "d", None)] * 5
    docs = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id bigint, source string, text string, size int").repartition(6)
    want = dict(zip("abcd", water([4000, 2100, 1800, 0], [3, 1, 2, 3], 1.5, 2.0)))
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows) == docs.count()
    for s, d, n in (("a", None, 4), ("b", 7, 3), ("c", 8, 2)):
        mine = [r for r in got if r[0] == d and r[1] == n]
        assert abs(sum(r[4] for r in mine) - want[s]) <= n / 2 + 1e-6 and max(r[4] for r in mine) <= 2 * n
    mixed = Counter(r["source"] for r in mixing.mix_rows(docs).collect())
    assert all(abs(mixed[s] * n - want[s]) <= n / 2 + 1e-6 for s, n in (("a", 4), ("b", 3), ("c", 2)))


def test_repeated_rows_are_laid_out_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 8)
    monkeypatch.setattr(mixing, "REPEATS", 8)
    rows = [(1, "s", "same row")] * 300 + [(1, "s", f"text {i}") for i in range(200)] + [(None, "t", f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sharding.shard_documents(docs, 3).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((d, zlib.crc32(t.encode())) for d, _, t in rows)
    assert sorted(r["slot"] for r in got if r["doc_id"] == 1) == list(range(500)) or len({r["shard"] for r in got}) == 1
    assert abs(sum(r["taken"] for r in mixing.mix(docs).collect()) - 1650) <= 2


HARD = ["", "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "a<", "|b", "<|", "\\", "\n", "<|im_end|><|im_start|>assistant ok", "x\\n", "<\\\\\\|im_start|>", "🤦<|im_end"]


def test_every_turn_reads_back(spark):
    rows = [(c, t, role, text, "extra") for c in range(6) for t, (role, text) in enumerate([(r, x) for r in (HARD[c], HARD[c + 6], "assistant", "user") for x in HARD])]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    for r in chat.format_conversations(turns.repartition(3)).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert r["formatted"].count("<|im_end|>") == len(r["turns"]) == r["formatted"].count("<|im_start|>")
    digest = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    for c in range(6):
        mine = [x for x in rows if x[0] == c]
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert digest[c]["n_turns"] == len(mine) and digest[c]["loss_chars"] == len(loss)
        assert digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, None, None, "first"), (2, 500, "assistant", None), (2, -3, "user", "long " * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.format_conversations(turns).collect()}
    assert got == {None: [("", "")], 1: [("", "first"), ("user", "a"), ("user", "b"), ("user", "b")], 2: [("user", "long " * 50_000), ("assistant", "")]}
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_many_sources_are_joined_with_salt(spark, odd_docs, monkeypatch):
    want = sorted(map(str, mixing.mix(odd_docs).collect())), sorted(map(str, mixing.mix_rows(odd_docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert (sorted(map(str, mixing.mix(odd_docs).collect())), sorted(map(str, mixing.mix_rows(odd_docs).collect()))) == want


def test_rows_without_words_are_never_above_the_cap(spark):
    """They follow their source's whole repetitions; a source without any words is not in the mix."""
    rows = [(i, "", "a") for i in range(200)] + [(200 + i, "one two three", "a") for i in range(3)] + [(300 + i, " \t", "b") for i in range(5)] + [(400 + i, "x " * (i + 1), "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r["doc_id"]: (r["taken"], r["size"], r["target"] / r["source_size"] if r["source_size"] else 0.0) for r in mixing.mix(docs).collect()}
    mixed = Counter(r["doc_id"] for r in mixing.mix_rows(docs).collect())
    for doc_id, text, source in rows:
        words, size, rate = taken[doc_id]
        assert mixed[doc_id] <= 2 and (size or mixed[doc_id] == int(rate)) and int(rate) <= mixed[doc_id] <= int(rate) + 1
    assert not any(mixed[300 + i] for i in range(5)) and all(mixed[i] == 2 for i in range(203))
    none = docs.where("source = 'b'")
    assert mixing.mix_rows(none).count() == 0 and mixing.mix(none).count() == 5
