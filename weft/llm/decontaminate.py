"""Benchmark decontamination by a distributed positional inverted index.

The training texts are dealt into shards of about ``shard_words`` words (a longer text is a shard of its own). Each shard
holds, for every one of its terms, the sorted positions of that term; texts lie one after another with a gap, so no
phrase runs over an end. The index is written to the shared folder and can be asked again.

A question is a set of phrases (the windows of the benchmark items). In each shard the lists of the test terms are
intersected after adjusting for offsets, beginning with the rarest term: an occurrence of an item's i-th word at p is an
alignment p - i, and the neighbours' lists say how far the text agrees with the item to the left and to the right. Runs
of ``window`` words or more are hits. Every window contains an anchor (its rarest term in that shard), so none is missed.

Benchmarks of any size are asked in blocks of at most ``block_words`` words; only a block is ever broadcast.

Defined results: a null text has no words and is never contaminated; an item without words is ignored; an item shorter
than a window is one window; items with one id count once, a null id counts as the empty string; repeated rows give one
row each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.sampling import sized
from weft.llm.text import words_of
from weft.session import materialize, scratch


def _postings(shard: int, ids: list, lengths: list[int], codes: list[np.ndarray], terms: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    """The rows of one shard: a row a text, then a row a term; codes has the places of each text's words in ``terms``."""
    texts, blank = len(ids), len(terms)
    lengths = np.array(lengths, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=blank)
    ends = np.cumsum(counts)
    position = (np.arange(len(code), dtype=np.int32) + np.repeat(np.arange(texts, dtype=np.int32), lengths))[order]
    delta = np.diff(position, prepend=np.int32(0))  # each list: its first position, then the steps
    if len(code):
        delta[ends - counts] = position[ends - counts]
    offsets = np.concatenate([np.zeros(texts + 1, np.int32), ends.astype(np.int32)])
    of_texts = pa.nulls(texts, pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(texts + blank, shard)),
            pa.concat_arrays([of_texts, pa.array(terms, pa.binary())]),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(delta)),
            pa.concat_arrays([pa.array(np.arange(texts, dtype=np.int32)), pa.nulls(blank, pa.int32())]),
            pa.array(np.concatenate([starts, np.zeros(blank, np.int64)])),
            pa.array(np.concatenate([lengths, counts])),
            pa.concat_arrays([pa.array(ids, id_type), pa.nulls(blank, id_type)]),
        ],
        ["shard", "term", "steps", "text_no", "start", "n", "id"],
    )


def _shards(batches, shard: int, shard_words: int, rows: int = 20_000):
    """The rows of all shards of the (id, text) batches, at most ``rows`` at once. Of a shard's words only their codes are held."""
    ids, lengths, codes, size, id_type = [], [], [], 0, None
    terms: dict[bytes, int] = defaultdict(itertools.count().__next__)

    def written():
        table = _postings(shard, ids, lengths, codes, list(terms), id_type)
        for i in range(0, table.num_rows, rows):
            yield table.slice(i, rows)

    for batch in batches:
        id_type = batch.column(0).type
        for key, text in zip(batch.column(0), batch.column(1)):
            words = words_of(text.as_py())
            if ids and size + len(words) > shard_words:
                yield from written()
                shard, size = shard + 1, 0
                ids, lengths, codes, terms = [], [], [], defaultdict(itertools.count().__next__)
            ids.append(key.as_py())
            lengths.append(len(words))
            codes.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
            size += len(words) + 1
    if ids:
        yield from written()


def build_index(docs: DataFrame, id_col: str, text_col: str, shard_words: int = 1_000_000) -> DataFrame:
    """Positional postings of all terms of all texts, written to the shared folder.

    Rows with a text_no are texts (id, start position and number of words); the others are terms (n positions).
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("steps", T.ArrayType(T.IntegerType())),
        T.StructField("text_no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("id", kind),
    ])

    def build(batches):
        yield from _shards(batches, TaskContext.get().partitionId() << 32, shard_words)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(build, schema), "postings")


def _anchors(words: list[bytes], window: int, frequency: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(place, first, last) for each chosen place: the windows that it stands for start from first to last."""
    size = min(window, len(words))
    counts = [frequency.get(w, 0) for w in words]
    out: list[tuple[int, int, int]] = []
    for j in range(len(words) - size + 1):
        span = counts[j : j + size]
        if not (least := min(span)):
            continue  # a word that the shard lacks: no occurrence
        if out and out[-1][0] >= j and counts[out[-1][0]] == least and out[-1][2] == j - 1:
            out[-1] = (out[-1][0], out[-1][1], j)
        else:
            out.append((j + span.index(least), j, j))
    return out


def _within(sorted_list: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, wanted)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == wanted


def phrase_runs(lists: dict[bytes, np.ndarray], words: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, end) positions of the stretches that agree with ``words`` over whole windows."""
    out, size = [], min(window, len(words))
    for place, first, last in _anchors(words, window, {w: len(lists[w]) for w in words if w in lists}):
        at = lists[words[place]].astype(np.int64)
        left, right, alive = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(1, place - first + 1):  # an alignment that has broken off is not looked at again
            if not alive.any() or words[place - k] not in lists:
                break
            alive[alive] = _within(lists[words[place - k]], at[alive] - k)
            left += alive
        # with too little on the left, what is needed on the right may not fit: the run must reach a window in all
        alive = left + 1 + (last + size - 1 - place) >= size
        for k in range(1, last + size - place):
            if not alive.any() or words[place + k] not in lists:
                break
            alive[alive] = _within(lists[words[place + k]], at[alive] + k)
            right += alive
        full = left + right + 1 >= size
        if full.any():
            out.append((at[full] - left[full], at[full] + right[full] + 1))
    return out


def proximity_spans(lists: dict[bytes, np.ndarray], words: list[bytes], span: int) -> np.ndarray:
    """Starts x of all stretches [x, x + span) that hold every word of ``words`` as often as it stands there, in any order, and begin with one of them."""
    need = {w: words.count(w) for w in words}
    if any(w not in lists or len(lists[w]) < k for w, k in need.items()):
        return np.zeros(0, np.int64)
    starts = np.unique(np.concatenate([lists[w] for w in need])).astype(np.int64)
    rarest_first = sorted(need, key=lambda w: len(lists[w]))
    for w in rarest_first:
        have = np.searchsorted(lists[w], starts + span) - np.searchsorted(lists[w], starts)
        starts = starts[have >= need[w]]
    return starts


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    first, end = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], np.concatenate([end[:-1][new[1:]], end[-1:]])


def _items(benchmark: DataFrame, id_col: str, text_col: str, blocks: int, block: int) -> list[tuple[str, list[bytes]]]:
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    if blocks > 1:
        rows = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
    return [(r.id, w) for r in rows.distinct().toLocalIterator() if (w := words_of(r.text))]


def _asker(shared, window: int, span: int | None):
    """What is done with the postings of one shard; shared holds the items of one block."""

    def ask(table):
        is_text = np.asarray(table["text_no"].is_valid())
        steps = table["steps"].combine_chunks()
        values, offsets = np.asarray(steps.values), np.asarray(steps.offsets)
        lists = {t: np.cumsum(values[a:b], dtype=np.int64) for t, a, b, x in zip(table["term"].to_pylist(), offsets, offsets[1:], is_text) if not x}
        texts = table.filter(pa.array(is_text)).sort_by("text_no")
        start = np.asarray(texts["start"])
        firsts, ends, names, near = defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(set)
        runs = []
        for name, words in shared.value:
            if got := phrase_runs(lists, words, window):
                first, end = _merged(got)
                runs.append((first, end))
                for no in np.unique(np.searchsorted(start, first, "right") - 1).tolist():
                    names[no].add(name)
            if span is not None:
                # a stretch may not run over the end of its text
                x = proximity_spans(lists, words, span)
                no = np.searchsorted(start, x, "right") - 1
                limit = start[no] + np.asarray(texts["n"])[no]
                for one, a, b in zip(no.tolist(), x.tolist(), limit.tolist()):
                    if b - a >= span or all(np.searchsorted(lists[w], min(a + span, b)) - np.searchsorted(lists[w], a) >= words.count(w) for w in set(words)):
                        near[one].add(name)
        if runs:
            first, end = _merged(runs)
            no = np.searchsorted(start, first, "right") - 1
            for one, a, b in zip(no.tolist(), (first - start[no]).tolist(), (end - start[no]).tolist()):
                firsts[one].append(a)
                ends[one].append(b)
        hit = sorted({*names, *near})
        shard = table["shard"][0].as_py() if len(table) else 0
        return pa.table({
            "shard": pa.array([shard] * len(hit), pa.int64()), "text_no": pa.array(hit, pa.int32()),
            "firsts": pa.array([firsts[x] for x in hit], pa.list_(pa.int32())), "ends": pa.array([ends[x] for x in hit], pa.list_(pa.int32())),
            "items": pa.array([sorted(names[x]) for x in hit], pa.list_(pa.string())), "near": pa.array([sorted(near[x]) for x in hit], pa.list_(pa.string())),
        })

    return ask


def find_items(index: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int = 10, span: int | None = None, block_words: int = 1_000_000) -> DataFrame:
    """(shard, text_no, firsts, ends, items, near) of each text with a match: stretches of whole windows, the items they come from, and, with ``span``, the items whose words all stand within ``span`` words."""
    spark = index.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b")).first().b or 0
    blocks = max(1, -(-size // (2 * block_words)))  # two bytes a word and its space at least
    schema = "shard long, text_no int, firsts array<int>, ends array<int>, items array<string>, near array<string>"
    found = None
    for block in range(blocks):
        items = _items(benchmark, id_col, text_col, blocks, block)
        shared = spark.sparkContext.broadcast(items)
        terms = spark.createDataFrame([(bytearray(t),) for t in sorted({w for _, ws in items for w in ws})], "term binary")

        texts = index.where("text_no is not null")
        asked = index.where("text_no is null").join(F.broadcast(terms), "term", "left_semi")  # bounded by block_words
        one = texts.unionByName(asked).drop("id").groupBy("shard").applyInArrow(_asker(shared, window, span), schema)
        found = one if found is None else found.unionByName(one)
    if blocks == 1:
        return found
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one entry a block
    return found.groupBy("shard", "text_no").agg(flat("firsts"), flat("ends"), flat("items"), flat("near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  window: int = 10, span: int | None = None, shard_words: int = 1_000_000, block_words: int = 1_000_000) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_hit, n_items, items, near_items, contaminated."""
    index = build_index(docs, id_col, text_col, shard_words)
    found = find_items(index, benchmark, item_id_col, item_text_col, window, span, block_words)
    # stretches of several blocks may overlap: in order of their starts, each adds what lies beyond the furthest end
    stretches = F.array_sort(F.arrays_zip("firsts", "ends"))
    n_hit = F.aggregate(
        stretches,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["firsts"], a["to"]))).alias("n"), F.greatest(a["to"], x["ends"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    found = found.select("shard", "text_no", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near_items"))
    texts = index.where("text_no is not null").select("shard", "text_no", F.col("id").alias("_id"), F.col("n").alias("n_words"))
    none = F.array().cast("array<string>")
    return texts.join(found, ["shard", "text_no"], "left").select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"), (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", broadcast_rows: int = 100_000, **options) -> DataFrame:
    """The rows of ``docs`` whose text has no hit, with their columns. Whether a row goes depends on its text alone, so
    identifiers may be null or repeat. Texts move only if over ``broadcast_rows`` different ones are hit."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.concat(F.sha2(text, 256), F.lit(":"), F.octet_length(text).cast("string"))
    texts = docs.select(own.alias("digest"), text.alias("text"))
    with scratch(docs.sparkSession):  # the index is as large as the texts
        bad = decontaminate(texts, benchmark, "digest", "text", **options).where("contaminated").select(F.col("digest").alias("_bad")).distinct()
        bad = materialize(bad, "contaminated", outlives=True)
    rows = docs.select(F.struct("*").alias("_row"), own.alias("_own"))
    return rows.join(sized(bad, broadcast_rows), F.col("_own") == F.col("_bad"), "left_anti").select("_row.*")
