import pytest

from spanfold.functions.stem import english_stem, stem
from spanfold.functions.text import Analyzer, TextConfig, is_analyzer, plain_words, register, source, unaccent, vector, vector_text
from spanfold.plans.lang import QueryError


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("running", "run"), ("shoes", "shoe"), ("foxes", "fox"), ("jumped", "jump"), ("happy", "happi"), ("ties", "tie"), ("cries", "cri"),
        ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("communism", "communism"), ("skies", "sky"),
        ("by", "by"), ("national", "nation"), ("sensibility", "sensibl"), ("adjustment", "adjust"), ("agreed", "agre"), ("feed", "feed"), ("rate", "rate"),
        ("controlling", "control"), ("gas", "gas"), ("kiwis", "kiwi"), ("inning", "inning"), ("dogs'", "dog"), ("yell", "yell"), ("cosmos", "cosmos"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_stop_words():
    assert english_stem("the") == []
    assert english_stem("theses") != []


def test_plain_words():
    assert plain_words("A b-c D") == ["a", "b-c", "b", "c", "d"]
    assert plain_words("R&D mp3-Café x.y.z 🎂 C:\\dir 日本語") == ["r", "d", "mp3-café", "mp3", "café", "x.y.z", "c", "dir", "日本語"]
    assert source("english").tokens("the running dog") == [("run", 2), ("dog", 3)]
    assert source("simple_unaccent").lexemes("Été-Øre") == ["ete", "ete-ore", "ore"]


def v(text, name="icu"):
    return vector(Analyzer.named(name).tokens(text))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Élan vital", {"élan": [1], "elan": [1], "vital": [2]}),
        ("a STRASSE, a straße!", {"a": [1, 3], "strasse": [2, 4]}),
        ("red-hot iron", {"red-hot": [1], "red": [1], "hot": [1], "redhot": [1], "iron": [2]}),
        ("Q&A time", {"q&a": [1], "q": [1], "a": [1], "qa": [1], "time": [2]}),
        ("ask me@mail.site.org now", {"ask": [1], "me@mail.site.org": [2], "me": [2], "mail.site.org": [2], "mail": [2], "site": [2], "now": [3]}),
        ("at https://site.org/p?q, then", {"at": [1], "https://site.org/p?q,": [2], "site.org": [2], "site": [2], "then": [3]}),
        ("www.site.org v2.0 3.14", {"www.site.org": [1], "www": [1], "site": [1], "v2.0": [2], "3.14": [3]}),
        ("Ann’s 'tis", {"ann's": [1], "ann": [1], "anns": [1], "tis": [2]}),
        ("hi 🎂 you™", {"hi": [1], "🎂": [2], "you": [3]}),
        ("ＡＢ Ⅻ", {"ａｂ": [1], "ab": [1], "ⅻ": [2], "xii": [2]}),
        ("con\u00adfidential a\u200bb", {"confidential": [1], "ab": [2]}),
        ("a-b&c", {"a-b": [1], "a": [1], "b": [1], "ab": [1], "c": [2]}),
    ],
)
def test_analyzer(text, want):
    assert v(text) == want


def test_analyzer_variants():
    assert v("hi 🎂 you", "icu_no_emoji") == {"hi": [1], "you": [2]}
    assert v("Élan", "icu_accent") == {"élan": [1]}
    assert v("the running dogs", "icu:english_stem") == {"run": [2], "dog": [3]}
    assert v("x " + "y" * 2047 + " z") == {"x": [1], "z": [3]}
    icu = Analyzer.named("prox_icu")
    assert icu.lexemes("Red-Hot") == ["red-hot"]
    assert icu.lexemes("a/b") == ["a", "b"]
    assert icu.exact("Élan") == ["élan"]
    assert is_analyzer(" icu : english_stem ") and not is_analyzer("icu:nope") and not is_analyzer("simple")
    by_words = Analyzer("icu", words={"你好世界": ("你好", "世界")})
    assert vector(by_words.tokens("说 你好世界 ok")) == {"ok": [4], "世界": [3], "你好": [2], "说": [1]}


def test_limits_of_vectors():
    made = vector([("a", n) for n in range(1, 400)] + [("b", 20_000), ("b", 30_000), ("c" * 3000, 1)])
    assert made == {"a": list(range(1, 257)), "b": [16_383]}
    assert vector_text([("it's", 1), ("a\\b", 2)]) == "'it''s':1 'a\\\\b':2"


def test_own_configurations():
    register(TextConfig("shouting", str.upper))
    assert source("shouting").lexemes("a-b") == ["A", "A-B", "B"]
    with pytest.raises(QueryError):
        source("nothing")
    assert unaccent("Ångström œuvre") == "Angstrom oeuvre"
