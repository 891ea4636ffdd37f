"""Leaves of a query to what they stand for in an index: literally, through a configuration, or through an analyzer."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from spanfold.functions.text import Analyzer, TextConfig, source, unspaced_runs
from spanfold.plans.lang import Leaf, literal_head


@dataclass(frozen=True)
class Resolved:
    """kind `lexemes` with those that count, or `prefix`, `glob`, `regex` with the one pattern."""

    kind: str
    values: tuple[str, ...]


def dictionary_words(run: str) -> tuple[str, ...]:
    """A run of an unspaced script as the JVM's ICU library cuts it, on the driver, where queries are compiled."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return tuple(run)
    icu = spark._jvm.com.ibm.icu
    bounds = icu.text.BreakIterator.getWordInstance(icu.util.ULocale.ROOT)
    bounds.setText(run)
    units = run.encode("utf-16-le")
    out, at = [], bounds.first()
    while (end := bounds.next()) != -1:
        out.append(units[2 * at : 2 * end].decode("utf-16-le"))
        at = end
    return tuple(out)


@dataclass(frozen=True)
class Resolver:
    """How terms are looked up; without a source, byte by byte."""

    source: TextConfig | Analyzer | None = None

    @staticmethod
    def of(name: str | None) -> Resolver:
        return Resolver(None if name is None else source(name))

    def with_words_of(self, query: str) -> Resolver:
        """For an analyzer with dictionary words: with those of the query's own runs of unspaced scripts, which the index may not have as runs."""
        if not self.analyzer or not self.source.words:
            return self
        missing = [run for run in unspaced_runs(query) if run not in self.source.words]
        return Resolver(replace(self.source, words={**self.source.words, **{run: dictionary_words(run) for run in missing}})) if missing else self

    @property
    def analyzer(self) -> bool:
        return isinstance(self.source, Analyzer)

    def lexemes(self, term: str) -> list[str]:
        return [term] if self.source is None else self.source.lexemes(term)

    def folded(self, run: str) -> str:
        """A literal run of a prefix or glob: its one lexeme, or as it is where there is none or several."""
        if self.source is None or not run:
            return run
        found = self.source.lexemes(run)
        return found[0] if len(found) == 1 else run

    def glob(self, text: str) -> str:
        return text if self.source is None else re.sub(r"[^*?]+", lambda m: self.folded(m[0]), text)

    def leaf(self, leaf: Leaf) -> Resolved:
        if leaf.kind == "term":
            return Resolved("lexemes", tuple(self.lexemes(leaf.text)))
        if leaf.kind == "exact":
            return Resolved("lexemes", tuple(self.source.exact(leaf.text) if self.analyzer else self.lexemes(leaf.text)))
        if leaf.kind == "prefix":
            return Resolved("prefix", (self.folded(leaf.text),))
        return Resolved(leaf.kind, (self.glob(leaf.text) if leaf.kind == "glob" else leaf.text,))

    def key(self, leaf: Leaf) -> Resolved | None:
        """What selects candidates for a leaf through the index; none where nothing does."""
        if leaf.kind == "regex" or (leaf.kind == "glob" and not leaf.key):
            return None
        if leaf.kind == "glob":
            return Resolved("prefix", (self.folded(literal_head(leaf.text)),))
        found = self.leaf(leaf)
        return found if found.values else None
