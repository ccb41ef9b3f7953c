"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of ``slots`` rows holds the filters of all languages: bit l of a row belongs to language l, and a row has as many
64-bit words as the languages need. An n-gram's ``probes`` rows, ANDed, give the set of all languages that contain it, in one
look. A text's n-grams are looked up whole; each language's popcount is corrected for its filter's false positives,
(share - rate) / (1 - rate), and the largest decides. The filters hold every n-gram of a training sample of at most about
``max_rows`` rows a language (chosen by a hash of identifier and text); prediction reads every text in full.

Without ``slots`` the table has at least eight rows for each n-gram of the largest language, up to ``max_slots``; beyond that
the false positives grow, and are corrected for, but no n-gram is left out.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in order;
repeated rows give one row each and are learned from once; identifiers may be null; rows whose label is null are predicted and
not learned from; without any training row every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.sampling import bounded_sample
from weft.session import materialize

GRAM = 4
#: The score is the winner's part of all shares raised to this power: related languages have most n-grams in common.
SHARPNESS = 16
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _chunks(texts: list[str | None], size: int = 500_000) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each letter of the texts, of the n-gram that begins one before it, and the letter's text number.

    Letters are lower-cased, everything else counts as one blank; a gram never runs into another text.
    """
    gap = "\n" * GRAM
    lowered = [t.lower() for t in texts]
    code = np.frombuffer((gap + gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    value = code[at - 1]
    for k in range(GRAM - 1):
        # what follows the end of a word does not matter
        nxt = code[at + k] if k < 2 else np.where(code[at + k - 1] > 0, code[at + k], 0)
        value = value * np.uint64(0x110003) + nxt
    value ^= value >> np.uint64(31)
    value *= np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum([len(gap) + len(t) for t in lowered])  # where each text ends
    return value ^ (value >> np.uint64(32)), np.searchsorted(starts, at, "right") if len(texts) > 1 else np.zeros(len(at), np.int64)


def _slots(hashes: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(probes)]


class LanguageFilters(NamedTuple):
    languages: list[str]
    table: np.ndarray  # slots x words
    rates: np.ndarray  # false positives of each language's filter
    coverage: np.ndarray  # of each language's n-grams in unseen text, the part that its filter has (Good-Turing)
    probes: int


def predict(languages: list[str], table: np.ndarray, rates: np.ndarray, coverage: np.ndarray, probes: int, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and the winner's corrected share of n-grams, as part of what its filter can have, of each text."""
    hashes, owner = gram_hashes(texts)
    total = np.bincount(owner, minlength=len(texts)).astype(float)
    if not languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    at = _slots(hashes, len(table), probes)
    share = np.empty((len(texts), len(languages)))
    for word in range(table.shape[1]):
        masks = table[at[0], word]
        for more in at[1:]:
            masks = masks & table[more, word]
        for i in range(64 * word, min(64 * word + 64, len(languages))):
            found = np.bincount(owner, weights=((masks >> np.uint64(i % 64)) & np.uint64(1)).astype(float), minlength=len(texts))
            share[:, i] = found / np.maximum(total, 1)
    share = np.clip((share - rates) / (1 - rates), 0, 1)
    best = share.argmax(axis=1)
    sharp = (share / np.maximum(share.max(axis=1, keepdims=True), 1e-12)) ** SHARPNESS
    score = np.where(share.sum(axis=1) > 0, 1 / np.maximum(sharp.sum(axis=1), 1), 0.0)
    names = [languages[b] if n else "und" for b, n in zip(best, total)]
    return names, np.where(total > 0, score, 0.0), np.minimum(1, share.max(axis=1) / np.maximum(coverage[best], 1e-9))


def fit_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = 1500, slots: int | None = None, max_slots: int = 1 << 22, probes: int = 2) -> LanguageFilters:
    """Filters from the rows of ``docs`` with a label. N-grams are gathered and the filters filled in tasks; the table's rows come to the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sample, sizes = bounded_sample(rows, "lang", ["id", "text"], max_rows)

    def grams_of(batches):
        for batch in batches:
            lang = np.asarray(batch.column(0).to_pylist(), object)
            for name in sorted(set(lang)):
                texts = [t for t, own in zip(batch.column(1).to_pylist(), lang == name) if own]
                for chunk in _chunks(texts, 2_000_000):
                    gram, n = np.unique(gram_hashes(chunk)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.select("lang", "text").mapInArrow(grams_of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(found, "grams")
    stats = {r[0]: r for r in grams.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("once")).collect()}  # a row a language
    counts = {name: r.grams for name, r in stats.items()}
    languages = sorted(sizes)
    coverage = np.array([1 - stats[x].once / stats[x]["all"] if x in stats else 0.0 for x in languages])
    number = {name: i for i, name in enumerate(languages)}
    if slots is None:
        slots = min(max_slots, max(1 << 16, 1 << (8 * max(counts.values(), default=0) - 1).bit_length() if counts else 0))

    def fill(batches):
        for batch in batches:
            own = np.asarray([number[x] for x in batch.column(0).to_pylist()], np.int64)
            at = np.concatenate(_slots(np.asarray(batch.column(1)).view(np.uint64), slots, probes))
            own = np.tile(own, probes)
            bits = (np.uint64(1) << (own % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own // 64), pa.array(at), pa.array(bits)], ["word", "slot", "bits"])

    filled = grams.select("lang", "gram").mapInArrow(fill, "word long, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    table[filled["slot"].to_numpy(np.int64), filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    rates = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** probes for i in range(len(languages))])
    return LanguageFilters(languages, table, np.minimum(rates, 1 - 1e-9), coverage, probes)


def predict_languages(docs: DataFrame, model: LanguageFilters, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with lang_pred, score and share (of the text's n-grams, corrected)."""
    kept = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*(T.StructField(f"_{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_share", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # max_slots rows; plain arrays: workers need no copy of this package

    def run(batches):
        # texts are held for so many rows at once
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            names, scores, shares = [], [np.zeros(0)], [np.zeros(0)]
            for chunk in _chunks(batch.column(0).to_pylist()):
                got, score, share = predict(*shared.value, chunk)
                names += got
                scores.append(score)
                shares.append(share)
            own = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(shares))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], schema.names)

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_share").alias("share"))


def keep_known_languages(docs: DataFrame, model: LanguageFilters, text_col: str = "text", least_share: float = 0.75) -> DataFrame:
    """The rows of ``docs`` with letters and at least ``least_share`` of the n-grams that their language's filter can have."""
    fields = [f"_c{i}" for i in range(len(docs.columns))]
    found = predict_languages(docs.toDF(*fields), model, fields[docs.columns.index(text_col)])
    known = (F.col("lang_pred") != "und") & (F.col("share") >= least_share)
    return found.where(known).select(*[F.col(f).alias(c) for f, c in zip(fields, docs.columns)])
