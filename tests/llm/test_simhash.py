import numpy as np
import pytest
import xxhash

from framelake.llm import components, simhash
from framelake.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(prints, ids):
    group = list(range(len(ids)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted((d is None, d or 0, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(zip(ids, prints)))


def test_hot_keys_never_meet_in_one_task(spark, monkeypatch):
    """A component of most fingerprints, and keys that most of them share, take the ways of crowded ones."""
    monkeypatch.setattr(simhash, "CROWDED", 4)
    monkeypatch.setattr(components, "CROWDED", 4)
    monkeypatch.setattr(components, "FEW", 4)
    rows = [(d, " ".join(f"w{i}" if i != d % 200 else f"x{d}" for i in range(200))) for d in range(150)] + [(500 + d, f"other text {d} of its own") for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute([brute_print(t) for _, t in rows], [d for d, _ in rows])
    assert max(sum(r[3] == c for r in want) for c in {r[3] for r in want}) > 60
    assert result(simhash.near_duplicates(docs, max_run=8)) == want


def result(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in df.collect())


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    assert result(simhash.near_duplicates(docs)) == brute([brute_print(r["text"]) for r in rows], [r["doc_id"] for r in rows])


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(simhash.near_duplicates(odd_docs)) == brute([brute_print(t) for _, t in rows], [d for d, _ in rows])
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("max_run", [1, 3, 1024])
def test_links_hold_groups_together(spark, max_run):
    """Clusters of fingerprints some flips apart, alone in their keys or crowding them."""
    rng = np.random.default_rng(max_run)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), max_run)
    got = dict(connected_components(links).collect())
    want = brute([f & (2**64 - 1) for f in fps], list(range(len(fps))))
    groups = lambda pairs: sorted(map(sorted, {r: [i for i, x in pairs if x == r] for _, r in pairs}.values()))
    assert groups([(i, got.get(f, f)) for i, f in enumerate(fps)]) == groups([(i, c) for _, i, _, c in want])


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (7, 7), (None, 3)], "a bigint, b bigint")
    got = dict(connected_components(path).collect())
    assert got == dict.fromkeys(range(41), 0) | {100: 90, 90: 90}
