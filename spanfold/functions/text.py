"""Text to lexemes with positions: the plain tokenizer, configurations of dictionaries, and the analyzers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import regex

from spanfold.functions.stem import english_stem
from spanfold.plans.lang import QueryError

#: Limits of a document vector.
LAST_POSITION, MOST_POSITIONS, LONGEST = 16_383, 256, 2_046

#: A word, a dotted or a hyphenated run of words: the same expression in Python, Java and RE2.
_W = r"[\p{L}\p{M}\p{N}_]+"
PLAIN = rf"{_W}(?:-{_W})+|{_W}(?:\.{_W})+|{_W}"

Dictionary = Callable[[str], list[str] | None]
#: A dictionary gives a lexeme's outputs: none at all for a stop word, None for what it doesn't know.
DICTIONARIES: dict[str, Dictionary] = {"english_stem": english_stem, "simple": lambda lexeme: [lexeme]}


def plain_words(text: str) -> list[str]:
    """Lower-case words in order; a hyphenated one stands before its parts."""
    out: list[str] = []
    for token in regex.findall(PLAIN, text.lower()):
        out.append(token)
        if "-" in token:
            out += token.split("-")
    return out


# --- configurations

_FOLDED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "æ": "ae", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "œ": "oe", "ø": "o", "ŧ": "t", "þ": "th"}
_FOLDING = str.maketrans(_FOLDED)
_MARKS = regex.compile(r"\p{M}+")


def unaccent(text: str) -> str:
    """Without combining marks, and letters that carry a stroke or are joined as ASCII."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text)).translate(_FOLDING)


@dataclass(frozen=True)
class TextConfig:
    """The plain tokenizer followed by a filter of each word and a dictionary."""

    name: str
    filter: Callable[[str], str] | None = None
    dictionary: Dictionary | None = None

    def tokens(self, text: str) -> list[tuple[str, int]]:
        """(lexeme, position); a stop word leaves its position empty."""
        out: list[tuple[str, int]] = []
        for n, token in enumerate(plain_words(text), 1):
            made = self.filter(token) if self.filter else token
            found = self.dictionary(made) if self.dictionary else None
            out += [(x, n) for x in ([made] if found is None else found)]
        return out

    def lexemes(self, term: str) -> list[str]:
        return sorted({x for x, _ in self.tokens(term)})

    exact = lexemes


CONFIGS: dict[str, TextConfig | Analyzer] = {c.name: c for c in (TextConfig("simple"), TextConfig("english", None, english_stem), TextConfig("simple_unaccent", unaccent))}


_registered = 0


def register(config: TextConfig | Analyzer) -> None:
    """Make a configuration, or an analyzer with dictionary words, known by its name."""
    global _registered
    CONFIGS[config.name] = config
    _registered += 1


def generation() -> int:
    """A number that changes whenever a configuration is registered."""
    return _registered


# --- analyzers

_APOSTROPHES = str.maketrans({"’": "'", "‘": "'", "ʼ": "'"})
_INVISIBLE = regex.compile("[­​‎‏‪-‮⁠⁦-⁩﻿]+")
_BOUND = regex.compile(r"(?V1w)\b")
#: Signs that are no part of a word that they stand before or after.
_ENDS = ".,;:!?()\""
_SPACES = re.compile("[ \t\n\r]+")
#: Marks without a letter, and flags, may be one piece with a space, so that texts with such can't be cut at their spaces; nor are those that dictionary words cut.
_CLINGING = regex.compile(r"(?:^|\s)[\p{M}\p{Cf}\p{Grapheme_Extend}\p{Emoji_Modifier}]|\p{Regional_Indicator}")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_EMOJI = regex.compile("[\\p{Emoji_Presentation}️]")
_HOST = regex.compile(r"(?:[\p{Alphabetic}\p{N}-]+\.)+\p{Alphabetic}{2,24}")
_URL = regex.compile(r"(?<![\p{Alphabetic}\p{N}])https?://\S*")
_URL_HOST = regex.compile(r"://([^/?#]+)")
_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")

#: base name: keeps dictionary words of unspaced scripts whole, folds accents, keeps emoji
_BASES = {"icu": (True, True, True), "unicode": (False, True, True), "icu_accent": (True, False, True), "icu_no_emoji": (True, True, False)}


@dataclass(frozen=True)
class Analyzer:
    """Unicode words with every useful form of a token at its one position.

    `words` maps runs of unspaced scripts to their dictionary words (see sources.index.script_words); a run it
    lacks is cut into characters.
    """

    name: str
    accents: bool = True
    emoji: bool = True
    by_words: bool = True
    dictionary: Dictionary | None = None
    words: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    @staticmethod
    def named(name: str) -> Analyzer | None:
        """`<base>` or `<base>:<dictionary>`; a base may be written with `prox_` before it."""
        base, colon, dictionary = (name.partition(":") if ":" in name else (name, "", ""))
        base, dictionary = (base.strip(), dictionary.strip()) if colon else (base, "")
        traits = _BASES.get(base.removeprefix("prox_"))
        if traits is None or (colon and dictionary not in DICTIONARIES):
            return None
        return Analyzer(name, traits[1], traits[2], traits[0], DICTIONARIES[dictionary] if colon else None)

    # --- forms of a token

    def _emit(self, out: list[tuple[str, int]], lexeme: str, at: int) -> None:
        if len(lexeme.encode("utf-8", "surrogatepass")) > LONGEST:
            return
        found = self.dictionary(lexeme) if self.dictionary else None
        out += [(x, at) for x in ([lexeme] if found is None else found)]

    def _forms(self, raw: str) -> tuple[str, str, str]:
        cased = raw.casefold()
        accented = unaccent(cased) if self.accents else cased
        return cased, accented, unicodedata.normalize("NFKC", accented)

    def _put(self, out: list[tuple[str, int]], raw: str, at: int, query: bool) -> None:
        cased, accented, canonical = self._forms(raw)
        for form in (canonical,) if query else dict.fromkeys((cased, accented, canonical)):
            self._emit(out, form, at)

    # --- segments

    def segments(self, text: str) -> list[str]:
        """Pieces between word bounds; with dictionary words, those of unspaced scripts."""
        if not self.by_words or not self.words:
            return [s for s in _BOUND.split(text) if s]
        out: list[str] = []
        at = 0
        for run in _RUN.finditer(text):
            if run[0] in self.words:
                out += [s for s in _BOUND.split(text[at : run.start()]) if s]
                out += self.words[run[0]]
                at = run.end()
        return out + [s for s in _BOUND.split(text[at:]) if s]

    def _region(self, text: str, out: list[tuple[str, int]], at: int, query: bool) -> int:
        parts = self.segments(text)
        i = 0
        while i < len(parts):
            part = parts[i]
            following = parts[i + 1] if i + 2 < len(parts) else ""
            if not _ALNUM.search(part):
                if self.emoji and _EMOJI.search(part):
                    at += 1
                    out.append((part, at))
                i += 1
                continue
            at += 1
            if following == "@" and "." in parts[i + 2] and _ALNUM.search(parts[i + 2]):
                host = parts[i + 2]
                more = [part, host, *host.split(".")[:-1]]
                part, i = f"{part}@{host}", i + 3
            elif following in ("-", "&") and _ALNUM.search(parts[i + 2]):
                more, i = [part], i + 1
                while i + 1 < len(parts) and parts[i] == following and _ALNUM.search(parts[i + 1]):
                    more.append(parts[i + 1])
                    i += 2
                part = following.join(more)
                more.append(part.replace(following, ""))
            else:
                i += 1
                more = []
                if "." in part and _HOST.fullmatch(part):
                    more = part.split(".")[:-1]
                elif "'" in part:
                    head = part[: part.index("'")]
                    more = [*([head] if head else []), part.replace("'", "")]
            for form in (part,) if query else (part, *more):
                self._put(out, form, at, query)
        return at

    def tokens(self, text: str, query: bool = False) -> list[tuple[str, int]]:
        """(lexeme, position) of an index's side, or of a query's: there a token has its one canonical form."""
        return self.cut(prepared(text), query)[0]

    def stretches(self, text: str) -> list[str]:
        """A prepared text cut at its spaces, over which no token reaches: cut() of each, one after another, are the tokens of the text."""
        clean = prepared(text)
        return [clean] if not clean.isascii() and (self.words or _CLINGING.search(clean)) else [s for s in _SPACES.split(clean) if s]

    def cut(self, clean: str, query: bool = False) -> tuple[list[tuple[str, int]], int]:
        """Tokens of a prepared text or of a stretch of it, and how many positions it takes."""
        out: list[tuple[str, int]] = []
        core = clean.strip(_ENDS)
        if core.isascii() and core.isalnum():  # all forms of such a word are one
            self._emit(out, core.lower(), 1)
            return out, 1
        at = start = 0
        for url in _URL.finditer(clean):
            at = self._region(clean[start : url.start()], out, at, query) + 1
            self._put(out, url[0], at, query)
            host = _URL_HOST.search(url[0])
            if host and not query:
                for form in (host[1], *host[1].split(".")[:-1]):
                    self._put(out, form, at, query)
            start = url.end()
        return out, self._region(clean[start:], out, at, query)

    def lexemes(self, term: str) -> list[str]:
        """What a bare term of a query stands for."""
        return sorted({x for x, _ in self.tokens(term, query=True)})

    def exact(self, term: str) -> list[str]:
        """What a literal term stands for: its case folded, nothing else."""
        return [prepared(term).casefold()]


def prepared(text: str) -> str:
    """Composed, without invisible controls, apostrophes straight."""
    if text.isascii():
        return text
    return _INVISIBLE.sub("", unicodedata.normalize("NFC", text)).translate(_APOSTROPHES)


def is_analyzer(name: str) -> bool:
    return isinstance(CONFIGS.get(name), Analyzer) or Analyzer.named(name) is not None


def unspaced_runs(text: str) -> list[str]:
    """Runs of scripts that are written without spaces."""
    return _RUN.findall(prepared(text))


def source(name: str) -> TextConfig | Analyzer:
    """The configuration or analyzer of that name."""
    found = CONFIGS.get(name) or Analyzer.named(name)
    if found is None:
        raise QueryError(f"unknown analyzer '{name}'")
    return found


def vector(tokens: Iterator[tuple[str, int]] | list[tuple[str, int]]) -> dict[str, list[int]]:
    """Lexemes in order, each with its positions, within the limits of a vector."""
    found: dict[str, set[int]] = {}
    for lexeme, at in tokens:
        if len(lexeme.encode("utf-8", "surrogatepass")) <= LONGEST:
            found.setdefault(lexeme, set()).add(min(at, LAST_POSITION))
    return {x: sorted(found[x])[:MOST_POSITIONS] for x in sorted(found, key=str.encode)}


def vector_text(tokens: list[tuple[str, int]]) -> str:
    """A vector as text, 'lexeme':position for each token."""
    return " ".join("'" + lexeme.replace("\\", "\\\\").replace("'", "''") + f"':{at}" for lexeme, at in tokens)
