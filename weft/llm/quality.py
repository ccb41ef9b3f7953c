"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words (lower-cased A-Z, hashed into ``WORDS`` buckets), trigrams of character classes over all of its
bytes, and shares that prose keeps within narrow bounds (repeated words, distinct words, word length, mean line length).
Terms are weighted by log frequency and inverse document frequency and projected on the leading singular vectors of the
training matrix. The labelled vectors, at most about ``max_rows`` a label, are broadcast: a proven bound of 2 * max_rows *
dimensions floats. Every text's cosine with every labelled vector is computed, block by block; the ``neighbours`` nearest vote
with the weight of their similarity. A sampled vector stands for as many labelled rows as its label has for each sampled one,
and its vote is multiplied by that number, so scores mean the same whether or not the sample was cut.

Defined results: a null text counts as empty and gets a score like any other; repeated rows give one row each and are learned
from once; an identifier with conflicting labels has the largest; labels of null identifiers are not used; with labels of one
value only, the score is that value; without labels, 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.sampling import bounded_sample

#: Character classes, by byte: lower case, upper case, digit, blank, line end, then single signs, other ASCII, other UTF-8.
_SIGNS = b".,!?|#$%&*"
CLASSES = 17


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.uint16)
    table[0x80:] = 16
    for kind, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r")):
        table[list(chars)] = kind
    for i, sign in enumerate(_SIGNS):
        table[sign] = 5 + i
    return table


_TABLE = _classes()
TRIGRAMS = CLASSES**3
LEVELS = 12  # steps of each share
SHARES = 5
WORDS = 4096
TERMS = TRIGRAMS + LEVELS * SHARES + WORDS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and frequencies of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kind = _TABLE[np.frombuffer(raw, np.uint8)]
    if len(kind) >= 3:
        counts = np.bincount(kind[:-2] * np.uint16(CLASSES**2) + kind[1:-1] * np.uint16(CLASSES) + kind[2:], minlength=1)
        terms = np.flatnonzero(counts)
        weights = counts[terms] / len(kind)
    else:
        terms, weights = np.zeros(0, np.int64), np.zeros(0)
    words = raw.split()
    n = max(1, len(words))
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = raw.split(b"\n")
    number = Counter(raw.lower().split())
    shares = (
        repeated,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        min(1.0, len(raw) / n / 20),
        min(1.0, np.log1p(len(raw) / len(lines)) / 12),
    )
    own = [TRIGRAMS + i * LEVELS + min(LEVELS - 1, int(x * LEVELS)) for i, x in enumerate(shares)]
    buckets = np.fromiter((crc32(w) % WORDS for w in number), np.int64, len(number))
    counts = np.bincount(buckets, np.fromiter(number.values(), float, len(number)), minlength=1)
    used = np.flatnonzero(counts)
    return np.concatenate([terms, own, TRIGRAMS + LEVELS * SHARES + used]), np.concatenate([weights, np.full(SHARES, 0.02), counts[used] / n])


class NeighbourModel(NamedTuple):
    """idf, projection, labelled unit vectors, their labels and weights; without vectors every score is ``prior``."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray | None
    labels: np.ndarray | None
    weights: np.ndarray | None
    neighbours: int
    prior: float


def embed(idf: np.ndarray, projection: np.ndarray, texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), projection.shape[1]), np.float32)
    for i, text in enumerate(texts):
        terms, freq = features(text)
        x = np.log1p(1000 * freq) * idf[terms]
        out[i] = x.astype(np.float32) @ projection[terms]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def score(idf, projection, vectors, labels, weights, neighbours, prior, texts: list[str | None], block: int = 1024) -> np.ndarray:
    """The weighted vote of each text's nearest labelled vectors, by exact cosines."""
    if vectors is None:
        return np.full(len(texts), prior)
    out = np.zeros(len(texts))
    for i in range(0, len(texts), block):
        cosine = embed(idf, projection, texts[i : i + block]) @ vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8 * weights[near]
        out[i : i + block] = ((vote * labels[near]).sum(axis=1) + 1e-9 * prior) / (vote.sum(axis=1) + 1e-9)
    return np.clip(out, 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 1500, dimensions: int = 48, neighbours: int = 25) -> NeighbourModel:
    """A model from the labelled rows, at most about ``max_rows`` a label, whatever repeats: the bound holds what is sent out and what comes to the driver."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    marks, full = bounded_sample(marks, "_label", ["_id"], max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(marks), "_id")  # about 2 * max_rows rows
    rows, _ = bounded_sample(rows, "_label", ["_id", "_text"], max_rows)  # identifiers of documents may repeat

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["label", "terms", "freq"])

    got = rows.select(F.col("_label"), "_text").mapInArrow(run, "label int, terms array<int>, freq array<float>").toPandas()
    got["terms"], got["freq"] = [np.asarray(x, np.int64) for x in got["terms"]], [np.asarray(x, np.float64) for x in got["freq"]]
    y = got["label"].to_numpy(dtype=float)
    stands_for = {value: full[value] / max(1, int((y == value).sum())) for value in full}
    weights = np.array([max(1.0, stands_for[int(v)]) for v in y])
    prior = float((weights * y).sum() / weights.sum()) if len(y) else 0.5
    if len(set(y)) < 2:
        return NeighbourModel(np.ones(TERMS), np.zeros((TERMS, 1), np.float32), None, None, None, neighbours, prior)
    order = np.lexsort([[len(t) for t in got["terms"]], [float(f.sum()) for f in got["freq"]], y])  # whatever order the rows came in
    got, y, weights = got.iloc[order], y[order], weights[order]
    # only terms that occur have a column
    used = np.unique(np.concatenate(list(got["terms"])))
    x = np.zeros((len(got), len(used)), np.float32)
    for i, (terms, freq) in enumerate(zip(got["terms"], got["freq"])):
        x[i, np.searchsorted(used, terms)] = np.log1p(1000 * freq)
    idf = np.full(TERMS, np.log(1 + len(x)) + 0.2)
    idf[used] = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 0.2
    x *= idf[used].astype(np.float32)
    # leading right singular vectors by the smaller of the two Gram matrices
    if len(used) <= len(x):
        vectors = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dimensions]
    else:
        values, left = np.linalg.eigh(x @ x.T)
        values, left = values[::-1][:dimensions], left[:, ::-1][:, :dimensions]
        vectors = x.T @ left / np.sqrt(np.maximum(values, 1e-9))
    projection = np.zeros((TERMS, vectors.shape[1]), np.float32)
    projection[used] = vectors
    latent = x @ projection[used]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return NeighbourModel(idf, projection, latent, y, weights, neighbours, prior)


def score_quality(docs: DataFrame, model: NeighbourModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with score."""
    kept = docs.columns if keep is None else keep
    schema = T.StructType([*(T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(kept)), T.StructField("_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain arrays: TERMS * dimensions + 2 * max_rows * dimensions floats

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score(*shared.value, texts), pa.float64())], schema.names)

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], F.col("_score").alias("score"))
