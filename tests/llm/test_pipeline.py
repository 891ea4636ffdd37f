import re

from pyspark.sql import functions as F

import corpus_pipeline
from spanfold.llm import packing, quality
from spanfold.llm.decontaminate import PHRASE, item_tokens

SF = "/root/testdata/sf0.001"


def test_the_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}

    # quality: every text scored by itself
    model = quality.fit(docs, labels)
    pair = model.compressors()
    want = {i for i, r in rows.items() if (s := quality.score_of(r.text, model, *pair)) is not None and s >= quality.THRESHOLD}
    kept = corpus_pipeline.classify(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want

    # near duplicates: no two texts that are kept are alike, and whatever went has one that is
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    unique = corpus_pipeline.deduplicate(spark, kept, SF)
    assert unique.columns == docs.columns
    ids = {r.doc_id for r in unique.collect()}
    assert ids <= want
    shingles = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i in want for w in [re.findall(r"\w+", rows[i].text.lower())]}

    def alike(a, b):
        return len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))

    for i in want - ids:
        assert max(alike(i, j) for j in want if j != i) > 0.4
    long = [i for i in ids if len(shingles[i]) > 30]
    assert all(alike(a, b) < 0.7 for n, a in enumerate(long) for b in long[:n])

    # decontamination: phrases by plain comparison of word sequences
    unique = spark.createDataFrame(unique.collect(), docs.schema)
    clean = {r.doc_id for r in corpus_pipeline.decontaminated(spark, unique, SF).collect()}
    phrases = set()
    for item in item_tokens(bench):
        n = min(PHRASE, len(item))
        phrases |= {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
    sizes = {len(p) for p in phrases}
    for i, words in zip(ids, item_tokens([rows[i].text for i in ids])):
        leaked = any(tuple(words[k : k + n]) in phrases for n in sizes for k in range(len(words) - n + 1))
        assert (i not in clean) == leaked

    # packing: the stream of all that is left
    last = spark.createDataFrame([rows[i] for i in clean], docs.schema)
    windows = sorted(corpus_pipeline.packed(spark, last, SF).collect(), key=lambda r: r.window_id)
    encode = packing.Encoder(packing.VOCABULARY).encoding.encode_ordinary
    assert [x for r in windows for x in r.tokens] == [x for i in sorted(clean) for x in [*encode(rows[i].text), packing.EOS]]

    # and run() does the same
    whole = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.window_id)
    assert [r.tokens for r in whole] == [r.tokens for r in windows]


def test_stages_take_odd_rows(spark):
    from tests.llm import edge

    odd = edge.table(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(40))
    names = ["row", "quality_score", "quality_keep", "key", "k0", "k1", "k2", "keep", "some", "group_id", "__key", "__keep"]
    odd = odd.withColumns({n: F.lit("mine") for n in names})
    for empty in (False, True):
        now = odd.limit(0) if empty else odd
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            if number + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == odd.columns
                assert {r[n] for r in now.collect() for n in names} <= {"mine"}
        assert (now.count() == 0) == empty
