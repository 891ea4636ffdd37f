import random

from spanfold.llm.decontaminate import PHRASE, SHARE, SLOP, build_index, drop_leaks, item_tokens, leaks, stretches
from tests.llm import edge


def brute_phrases(doc, item, size):
    """Longest common runs of at least size tokens."""
    out = []
    for s in range(len(doc)):
        for i in range(len(item)):
            if doc[s] == item[i] and (s == 0 or i == 0 or doc[s - 1] != item[i - 1]):
                n = 0
                while s + n < len(doc) and i + n < len(item) and doc[s + n] == item[i + n]:
                    n += 1
                if n >= size:
                    out.append((s, i, n))
    return sorted(out)


def brute_near(doc, item, size, counts):
    """Whether at least SHARE of the stretches stand in one passage, by the definition: a stretch stands where its rarest word does."""
    parts = stretches(item, size)
    span, places = size + SLOP, set()
    for k, part in enumerate(parts):
        rarest = min(set(part), key=lambda t: (counts.get(t, 0), t))
        for p, word in enumerate(doc):
            if word == rarest and any(set(part) <= set(doc[max(0, s) : s + span]) for s in range(p - span + 1, p + 1)):
                places.add((p, k))
    need = max(1, -(-int(SHARE * 1000) * len(parts) // 1000))
    reach = len(item) + SLOP * len(parts)
    return any(len({k for q, k in places if p <= q < p + reach}) >= need for p, _ in places)


def world(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 12, 25, 30, 40)]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        kind = i % 6
        item = rng.choice(items).split()
        if kind == 1:
            text[10:10] = item
        elif kind == 2:
            text[5:5] = item[: len(item) // 2 + 4]
        elif kind == 3:
            moved = list(item)
            for k in range(0, len(moved) - 2, 4):
                moved[k], moved[k + 1] = moved[k + 1], moved[k]
            text[0:0] = moved
        elif kind == 4:
            text += [w.upper() + "," for w in item]
        docs.append((i, " ".join(text), "en", "a", 0))
    return docs, items


def test_against_brute_force(spark):
    docs, items = world()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = leaks(edge.table(spark, docs), bench, item_chars=150 if batch == 7 else 4_000_000).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        tokens = dict(zip([d[0] for d in docs], item_tokens([d[1] for d in docs])))
        phrases, near = {}, set()
        for r in got:
            if r.kind == "phrase":
                phrases.setdefault((r.doc_id, r.item_id), []).append((r.start, r.item_start, r.tokens))
            else:
                near.add((r.doc_id, r.item_id))
        counts = {}
        for w in (w for doc in tokens.values() for w in doc):
            counts[w] = counts.get(w, 0) + 1
        for d, doc in tokens.items():
            for k, item in enumerate(items):
                item = item.split()
                size = min(PHRASE, len(item))
                assert sorted(phrases.get((d, k), [])) == brute_phrases(doc, item, size)
                assert ((d, k) in near) == brute_near(doc, item, size, counts)
                # a passage that stands there word for word is a proximity match too
                if any(n == len(item) for _, _, n in phrases.get((d, k), [])):
                    assert (d, k) in near


def test_moved_words_are_found_by_proximity(spark):
    item = [f"t{i}" for i in range(30)]
    moved = [x for k in range(0, 30, 2) for x in (item[k + 1], item[k])]
    docs = edge.table(spark, [(1, "some words " + " ".join(moved) + " more words", "en", "a", 0), (2, " ".join(item[:12:2]), "en", "a", 0)])
    got = leaks(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(1, 9, "proximity")]


def test_the_index_holds_every_token(spark):
    docs, _ = world()
    postings, documents = build_index(edge.table(spark, docs))
    stored = postings.agg({"n": "sum"}).first()[0]
    assert stored == sum(len(t) for t in item_tokens([d[1] for d in docs]))
    assert sum(len(r.ids) for r in documents.collect()) == len(docs)


def test_edge_rows(spark):
    df = edge.table(spark, extra=["item_id", "kind", "start", "segment", "term", "key", "row", "__key"])
    bench = spark.createDataFrame([(1, "twice the same row"), (1, "twice the same row"), (None, "TEXT without an id"), (2, None), (3, ""), (4, "...")], "item_id int, text string")
    rows = [(r.doc_id, r.item_id) for r in leaks(df, bench).where("kind = 'phrase'").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(6, 1)] * 4 + [(None, None)]))
    kept = drop_leaks(df, bench, least=1)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    assert {r[n] for r in rows for n in ("key", "row", "__key")} == {"mine"}
    assert drop_leaks(df, bench).count() == len(edge.ROWS)  # items of four words drop nothing
    assert leaks(edge.table(spark, []), bench).collect() == []
    assert leaks(df, bench.limit(0)).collect() == []
    assert drop_leaks(df, bench.limit(0)).count() == len(edge.ROWS)


def test_passages_end_with_their_document():
    """An item so long that its reach goes beyond the gap between two documents."""
    import numpy as np

    from spanfold.llm.decontaminate import GAP, PHRASE, SHARE, SLOP, matches

    item = [f"w{n}" for n in range(PHRASE * 300)]
    parts = [item[a : a + PHRASE][::-1] for a in range(0, len(item), PHRASE)]  # no phrase, but each stretch in another order
    all_ = [w for p in parts for w in p]

    def found(*documents):
        starts, lists, at = [], {}, 0
        for words in documents:
            starts.append(at)
            for n, w in enumerate(words):
                lists.setdefault(w, []).append(at + n)
            at += len(words) + GAP
        counts = {w: len(x) for w, x in lists.items()}
        got = matches([(0, item)], {w: np.array(x) for w, x in lists.items()}, counts, PHRASE, SLOP, SHARE, starts)
        return [(int(np.searchsorted(starts, p, side="right")) - 1, kind, p - starts[int(np.searchsorted(starts, p, side="right")) - 1], n) for _, kind, p, _, n in got]

    need = int(SHARE * 300)
    few = [w for p in parts[: need - 1] for w in p]
    last = [w for p in parts[need - 1 :] for w in p]
    assert found(few, last) == []  # together they would have enough
    passages = [(d, p, n) for d, kind, p, n in found(all_, all_) if kind == "proximity"]
    assert len(passages) == 2 and passages[0][1:] == passages[1][1:] and [d for d, *_ in passages] == [0, 1]


def test_stretches_of_one_word(spark):
    """Items of one word, or of one word many times, over segments of which some lack it."""
    docs = [(1, "alpha beta", "en", "a", 0), (2, "gamma delta", "en", "a", 0), (3, "ha " * 12, "en", "a", 0), (4, "ha ha ha", "en", "a", 0), (5, "alpha", "en", "a", 0)]
    bench = spark.createDataFrame([(1, "alpha"), (2, "ha " * 10), (3, "omega"), (4, "alpha omega")], "item_id int, text string")
    for batch in (1, 2, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.doc_id, r.item_id, r.kind) for r in leaks(edge.table(spark, docs), bench).collect()}
        kept = sorted(r.doc_id for r in drop_leaks(edge.table(spark, docs), bench).collect())
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {(1, 1, "phrase"), (1, 1, "proximity"), (5, 1, "phrase"), (5, 1, "proximity"), (3, 2, "phrase"), (3, 2, "proximity"), (4, 2, "proximity")}
        assert kept == [1, 2, 5]  # one word alone drops no document
