import random

import pyarrow as pa
import pytest

from spanfold.llm import packing
from spanfold.llm.packing import EOS, VOCABULARY, Encoder, pack
from tests.llm import edge


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


def test_encoding_is_that_of_the_tokenizer(encoder):
    rng = random.Random(2)
    odd = [" ", "  ", "\n", " \n", "\t x", "a b", "a  b", "a  b", "it's we'll", " 's", "x  y", "日本 語", "🎂 a", "end ", " start", "1 2 34", "a,b ,c", "ß İ", "\r\n a", "a\x1c b"]
    texts = ["", None, "plain words here", "plain words here"] + [rng.choice(["w", "word,", ""]) + rng.choice(odd) + rng.choice(["w", "", "z z"]) + rng.choice(odd) for _ in range(500)]
    tokens, offsets = encoder.batch(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tokens[offsets[i] : offsets[i + 1]].tolist() == (encoder.encoding.encode_ordinary(t) if t else []), repr(t)


def brute(encoder, rows, window):
    stream, marks = [], []
    for i, t in rows:
        if t:
            for k, x in enumerate([*encoder.encoding.encode_ordinary(t), EOS]):
                stream.append(x)
                marks.append((i, k))
    return [(stream[a : a + window], marks[a : a + window]) for a in range(0, len(stream), window)]


@pytest.mark.parametrize(("window", "run", "part"), [(16, 1 << 20, 1 << 20), (16, 40, 200), (1, 7, 100), (5000, 30, 64)])
def test_against_brute_force(spark, encoder, monkeypatch, window, run, part):
    monkeypatch.setattr(packing, "RUN", run)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["some", "words", "of", "text,", "and"]) for _ in range(rng.choice([0, 1, 5, 60]))), "en", "a", 0) for i in range(60)]
    rng.shuffle(rows)
    got = sorted(pack(edge.table(spark, rows), window, part_bytes=part).collect(), key=lambda r: r.window_id)
    want = brute(encoder, sorted((r[0], r[1]) for r in rows), window)
    assert [r.window_id for r in got] == list(range(len(want)))
    for r, (tokens, marks) in zip(got, want):
        assert r.tokens == tokens
        assert r.n_tokens == len(tokens)
        ends = [*r.piece_starts[1:], len(tokens)]
        assert [(d, f + k) for d, f, a, b in zip(r.doc_ids, r.doc_froms, r.piece_starts, ends) for k in range(b - a)] == marks


def test_edge_rows(spark, encoder):
    df = edge.table(spark, extra=["tokens", "start", "part", "n", "window_id"])
    got = sorted(pack(df, 100).collect(), key=lambda r: r.window_id)
    total = sum(len(encoder.encoding.encode_ordinary(r[1])) + 1 for r in edge.ROWS if r[1])
    assert sum(r.n_tokens for r in got) == total
    assert all(r.n_tokens == 100 for r in got[:-1])
    assert got[0].doc_ids[0] is None
    assert [x for r in got for x in r.tokens].count(EOS) == sum(1 for r in edge.ROWS if r[1])
    assert pack(edge.table(spark, [])).collect() == []
    assert pack(edge.table(spark, [(1, None, None, None, None), (2, "", None, None, None)])).collect() == []
