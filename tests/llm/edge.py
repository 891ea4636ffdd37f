"""Awkward rows that every operator must take."""

LONG = "word " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Some plain text of a few words. Licensed under the MIT License", "en", "a", 60),
    (2, None, None, None, None),
    (None, "text without an id", "en", "a", 18),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", "en", None, 6),
    (5, LONG, "en", "b", len(LONG)),
    (6, "twice the same row", "en", "b", 18),
    (6, "twice the same row", "en", "b", 18),
    (6, "same id, other text", "en", "b", 19),
    (7, "¿Ünïcödé 日本語 🎂 ß İstanbul?", "xx", "a", 25),
    (8, "!!! ... ###", "en", "b", 11),
]


def table(spark, rows=None, extra=()):
    """The rows, with extra columns of the given names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({name: F.lit("mine") for name in extra}) if extra else df
