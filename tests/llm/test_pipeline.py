from collections import Counter

import corpus_pipeline
from framelake.llm import toxicity
from framelake.llm.scratch import materialize, table
from test_near_copies import brute_kept
from test_sharding_mixing_chat import water
from test_tokens_leaks_urls import brute_leaks

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    """Each stage against a plain version of it, on what its predecessor kept."""
    docs = table(spark, SF, "documents")
    scorer = toxicity.train(docs, table(spark, SF, "labels"))
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = materialize(stage(spark, docs, SF), "stage")
        if name == "toxicity":
            want = Counter(d for d, t, _ in rows if scorer.score(t) < 0.5)
        elif name == "simhash near-dedup":
            want = brute_kept([(d, t) for d, t, _ in rows])
        elif name == "benchmark decontamination":
            leaked = {d for d, _ in brute_leaks([(d, t) for d, t, _ in rows], bench)}
            want = Counter(d for d, _, _ in rows if d not in leaked)
        elif name == "mixing sources":
            size = lambda t: len(t.encode().split())
            sources = sorted({s for _, _, s in rows})
            total = [sum(size(t) for _, t, s in rows if s == x) for x in sources]
            target = dict(zip(sources, water(total, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2.0)))
            got = ids(out)
            for x in sources:
                mine = [(d, size(t)) for d, t, s in rows if s == x]
                assert abs(sum(got[d] * n for d, n in mine) - target[x]) <= max(n for _, n in mine)
                assert max(got[d] for d, _ in mine) <= 2
            want = got
        else:
            want = Counter(d for d, _, _ in rows)
        assert ids(out) == want, name
        assert name == "sharding" or out.columns == docs.columns
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows_go_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns[:4] == ["doc_id", "size", "text_crc32", "law"]
