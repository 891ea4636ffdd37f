"""Quality classifier that compares how well two Zstandard dictionaries compress a text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import spread_out, with_columns

#: Documents of each class that training reads at most; the only bound, and it concerns labelled rows alone.
TRAINING_DOCS = 1_500
DICTIONARY_BYTES = 112_640
#: Bytes at which the evidence of a text counts half: shorter texts draw near the undecided 0.5.
HALF = 128
#: Score under which a document is rejected.
THRESHOLD = 0.3
BLOCK = 1_024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text and the calibration of their difference."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.good), _compressor(self.bad)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    kept = zstandard.ZstdCompressionDict(content)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, int]:
    """(bytes under the bad dictionary - bytes under the good one) / the larger sum over the text's blocks, and the text's bytes.

    Each block of BLOCK bytes is compressed by itself, so that a long text is judged by the dictionaries
    throughout and not by its own beginning.
    """
    data = memoryview(text.encode("utf-8", "surrogatepass"))
    g = b = 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / max(g, b, 1), len(data)


def score_of(text: str, model: Model, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float | None:
    """The calibrated probability that a text is good; none without a character other than white space."""
    if not text.strip():
        return None
    x, size = difference(text, good, bad)
    z = (model.slope * x + model.offset) * size / (size + HALF)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x) by penalised Newton steps; classes count alike."""
    if len(x) == 0 or y.min() == y.max():
        return 50.0, 0.0
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    penalty = np.diag([1e-2, 1e-6])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(good: list[str], bad: list[str]) -> Model:
    """Two thirds of each class build its dictionary, the rest calibrates."""

    def parts(texts: list[str]) -> tuple[list[bytes], list[str]]:
        building = [t for i, t in enumerate(texts) if i % 3] or texts
        blocks = [t.encode("utf-8", "surrogatepass") for t in building]
        return [b[i : i + BLOCK] for b in blocks for i in range(0, len(b), BLOCK)], texts[::3]

    if not good or not bad:
        raise ValueError("both good and bad labelled texts are needed")
    dictionaries, held = [], []
    for texts in (good, bad):
        samples, rest = parts(texts)
        try:
            content = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
        except zstandard.ZstdError:  # too few samples to choose from: their end serves as it is
            content = b"".join(samples)[-DICTIONARY_BYTES:]
        dictionaries.append(content)
        held.append(rest)
    compressors = [_compressor(d) for d in dictionaries]
    x = np.array([difference(t, *compressors)[0] for texts in held for t in texts])
    y = np.array([1] * len(held[0]) + [0] * len(held[1]))
    slope, offset = logistic(x, y)
    return Model(dictionaries[0], dictionaries[1], slope, offset)


def labelled(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """(text, quality) of at most `most` labelled documents of each class, the first by md5 of their id; their texts whole.

    An id with both labels, a null id or a null label, and null or empty texts teach nothing and are left out.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{quality_col}`").cast("int").alias("quality")).dropna()
    ids = ids.groupBy("__id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__other")).where("quality = __other").drop("__other")
    chosen = None
    for value in (1, 0):
        part = ids.where(F.col("quality") == value).orderBy(F.md5(F.col("__id").cast("string"))).limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # chosen has 2 * most rows of two numbers, whatever the size of the tables
    return texts.join(F.broadcast(chosen), "__id").where("text is not null and text != ''").select("text", "quality", F.md5(F.col("__id").cast("string")).alias("__order")).orderBy("__order", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS, **columns: str) -> Model:
    """Train on the bounded labelled sample; where that lacks a class, every text scores the undecided 0.5 and is kept."""
    rows = labelled(docs, labels, most, **columns).toPandas()
    good, bad = (rows.loc[rows.quality == q, "text"].tolist() for q in (1, 0))
    return train(good, bad) if good and bad else Model(b"", b"", 0.0, 0.0)


def nested(docs: DataFrame) -> Column:
    """All columns of docs as one struct named row, so that none of them is replaced where others of their names are added."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score, the calibrated probability of good text, and quality_keep, whether it reaches the threshold.

    Whole texts are compressed, block by block, in one narrow pass without exchange. The evidence of a text of
    n bytes is weighted by n / (n + HALF), so that a few words alone are not rejected. Null texts and texts
    without a character other than white space have no content to judge: their score is null and they are
    not kept. Ties with the threshold are kept. Repeated rows score alike. Other columns pass through; ones named
    quality_score or quality_keep are replaced. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, whatever the data

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sent.value
        good, bad = known.compressors()
        for texts in batches:
            yield pa.array((None if t is None else score_of(t, known, good, bad) for t in (x.as_py() for x in texts)), pa.float64())

    named = with_columns(spread_out(docs), {"quality_score": score(F.col(f"`{text_col}`").cast("string"))})
    return with_columns(named, {"quality_keep": F.coalesce(F.col("quality_score") >= threshold, F.lit(False))})
