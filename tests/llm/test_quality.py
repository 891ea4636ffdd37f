import math

import pytest
import zstandard

from spanfold.llm.quality import THRESHOLD, fit, labelled, score_of, score_quality, train
from tests.llm import edge

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labelled documents, judged on the others."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 3 != 0"))
    rows = score_quality(docs.where("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 10
    assert sum(r.quality_keep for r in good) / len(good) > 0.98
    assert sum(not r.quality_keep for r in bad) / len(bad) > 0.85
    ranks = sorted((r.quality_score, r.quality) for r in rows)
    below = sum(1 for i, (_, q) in enumerate(ranks) for _, p in ranks[i + 1 :] if q == 0 and p == 1)
    assert below / (len(good) * len(bad)) > 0.97


def test_scores_are_those_of_one_text_at_a_time(spark):
    model = train(["all good words here, and more of them. " * 5] * 9, ["%%% ### $$$ &&& *** !!! " * 8] * 9)
    pair = model.compressors()
    df = edge.table(spark, extra=["QUALITY_SCORE", "good"])
    rows = score_quality(df, model).collect()
    assert list(rows[0].asDict())[-2:] == ["quality_score", "quality_keep"]
    assert len(rows) == len(edge.ROWS)
    for r in rows:
        want = None if r.text is None else score_of(r.text, model, *pair)
        assert r.quality_score == want
        assert r.quality_keep == (want is not None and want >= THRESHOLD)
    assert score_quality(edge.table(spark, []), model).collect() == []


def test_scores_by_the_definition(spark):
    """Sizes of blocks under both dictionaries, their normalised difference, its logistic value: written out again."""
    model = train([f"good words number {i} and more of them, in sentences. " * 6 for i in range(30)], [f"@@{i} ### $$$ buy now!!! &&& " * 8 for i in range(30)])
    texts = ["good words in sentences", "@@ buy now!!!" * 300, "é" * 5_000, "a", " x ", "and more of them, " * 200 + "$$$ buy" * 50]
    sizes = []
    for content in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append([sum(len(packer.compress(t.encode()[k : k + 1024])) for k in range(0, len(t.encode()), 1024)) for t in texts])
    rows = score_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), model).orderBy("doc_id").collect()
    for r, g, b in zip(rows, *sizes):
        n = len(r.text.encode())
        z = (model.slope * (b - g) / max(b, g) + model.offset) * n / (n + 128)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_labelled_texts_are_read_whole(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "b " * 90_000)], "doc_id long, text string")
    rows = labelled(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect()
    assert sorted(len(r.text) for r in rows) == [180_000, 300_000]


def test_what_is_learned_from(spark):
    docs = edge.table(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (5, 0), (6, 1), (6, 0), (None, 1), (8, None), (99, 0)], "doc_id long, quality int")
    rows = labelled(docs, labels).collect()
    assert sorted((r.quality, r.text[:4]) for r in rows) == [(0, "word"), (1, "Some")]
    assert len(labelled(docs, labels, most=1).collect()) <= 2


def test_without_labels_all_is_undecided(spark):
    docs, labels = edge.table(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for table, given in ((docs, labels), (docs, labels.limit(0)), (edge.table(spark, []), labels)):
        scores = {r.quality_score for r in score_quality(table, fit(table, given)).collect()}
        assert scores <= {0.5, None}


def test_both_classes_are_needed():
    with pytest.raises(ValueError):
        train([], ["x"])
