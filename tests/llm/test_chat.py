import hashlib
import random

from pyspark.sql import functions as F

from spanfold.llm.chat import KINDS, escape, reconstruct, turns_to_events

SCHEMA = "conv_id long, seq long, kind string, message_id string, role string, text string, rendered string, at int"


def events(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def shown(*messages):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in messages)


def brute(rows):
    """The rules once more, with lists, one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        log = sorted({r[1:] for r in rows if r[0] == conv}, key=lambda e: (e[0], KINDS.index(e[1]), e[2], e[4] or "", e[3] or ""))
        names, texts, roles = [], {}, {}
        for _, kind, m, role, text in log:
            text = text or ""
            if kind in ("message", "start") or (kind == "delta" and m not in names):
                if m not in names:
                    names.append(m)
                    roles[m] = role
                elif role is not None:
                    roles[m] = role
                texts[m] = text
            elif m not in names:
                continue
            elif kind == "delta":
                texts[m] += text
            elif kind == "edit":
                texts[m] = text
                roles[m] = role if role is not None else roles[m]
            elif kind == "regenerate":
                names = names[: names.index(m) + 1]
                texts[m] = text
            elif kind == "delete":
                names.remove(m)
        out[conv] = (len(names), shown(*((roles[m] or "unknown", escape(texts[m])) for m in names)))
    return out


def test_a_log(spark):
    rows = [
        (1, 1, "message", "u1", "user", "hi"),
        (1, 2, "start", "a1", "assistant", None),
        (1, 4, "delta", "a1", None, "lo"),
        (1, 3, "delta", "a1", None, "hel"),
        (1, 4, "delta", "a1", None, "lo"),
        (1, 5, "message", "u2", "user", "later"),
        (1, 6, "regenerate", "a1", None, None),
        (1, 7, "delta", "a1", None, "better <|im_end|>"),
        (1, 8, "edit", "u1", None, "hi there"),
    ]
    got = reconstruct(events(spark, rows)).collect()
    assert [(r.conv_id, r.n_messages, r.rendered) for r in got] == [(1, 2, shown(("user", "hi there"), ("assistant", "better < |im_end|>")))]


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(30), rng.choice(KINDS), f"m{rng.randrange(4)}", rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", None, ""])) for _ in range(1500)]
    want = brute(rows)
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_messages, r.rendered) for r in reconstruct(events(spark, rows + rows[:200])).collect()}
    assert got == want


def test_edge_rows(spark):
    rows = [(None, None, "message", None, None, None), (None, 2, "delta", None, None, "x" * 100_000), (2, 1, None, "m", "user", "no"), (2, 2, "nonsense", "m", "user", "no"), (3, 1, "edit", "m", "user", "no")]
    got = {r.conv_id: (r.n_messages, r.rendered) for r in reconstruct(events(spark, rows)).collect()}
    assert got == {None: (1, shown(("unknown", "x" * 100_000))), 2: (0, ""), 3: (0, "")}
    assert reconstruct(events(spark, [])).collect() == []


def key(role, text):
    return hashlib.md5(((f"{len(role)}={role}" if role is not None else "-") + "|" + text).encode()).hexdigest()


def test_turns(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "é" * 700), (1, 2, "assistant", "🎂b" * 600), (2, 0, "assistant", None), (2, 0, "assistant", ""), (2, 1, None, "x"), (2, 1, None, "y"), (2, 1, "-", "x"), (None, None, "user", "z"), (None, None, "user", "w"), (None, 3, "user", "v"), (None, 3, "user", "v")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumns({n: F.lit(1) for n in ("seq", "kind", "key", "name", "n", "e", "copy")})
    assert turns_to_events(df).where("kind = 'delta'").count() == 5
    want = {}
    for conv, turn, role, text in sorted({(c, t, r, x or "") for c, t, r, x in turns}, key=lambda m: (str(m[0]), -1 if m[1] is None else m[1], key(m[2], m[3]))):
        want.setdefault(conv, []).append((role or "unknown", text))
    for revised in (False, True):
        got = {r.conv_id: (r.n_messages, r.rendered) for r in reconstruct(turns_to_events(df, revised=revised)).collect()}
        assert got == {c: (len(m), shown(*m)) for c, m in want.items()}
    assert turns_to_events(df.limit(0), revised=True).collect() == []


def test_a_revised_log_has_every_kind_of_event(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} " * 40) for c in range(20) for t in range(6)]
    log = turns_to_events(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), revised=True)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(KINDS)
    assert log.count() > log.distinct().count()
    got = {r.conv_id: r.rendered for r in reconstruct(log.repartition(3)).collect()}
    assert got == {c: shown(*((r, x) for k, _, r, x in turns if k == c)) for c in range(20)}


def test_events_without_a_number_each_apply(spark):
    rows = [(1, None, "delta", "m", "user", "ha"), (1, None, "delta", "m", "user", "ha"), (1, 5, "delta", "m", "user", "!"), (1, 5, "delta", "m", "user", "!")]
    assert [r.rendered for r in reconstruct(events(spark, rows)).collect()] == [shown(("user", "haha!"))]
