"""Near duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Equal fingerprints are one point. The 64 bits are grouped into partitions of correlated bits (correlations of all points).
If two points differ in at most T bits and the partitions' thresholds add up to T - partitions + 1, the points differ by no
more than the threshold in at least one partition; a threshold of -1 leaves a partition out. Thresholds are allocated, and
the number of partitions is chosen, by dynamic programming on estimated costs: signatures to emit and candidate pairs,
the latter from the counts of all points by partition value and, beyond distance 0, from the bits' frequencies.

Each point emits its value in each partition and, where the threshold is above 0, the values within it. Points that meet
at a signature are compared as whole fingerprints, so the result is exact. A signature that more than ``block_rows``
points share is dealt as pairs of blocks over many tasks. A task keeps links only as a forest, so a dense group of n points
gives n links, not n squared, and loses none between different components.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; fewer words than a shingle make one
shingle; repeated rows are points of one fingerprint; a null identifier counts as larger than all others (the component of
null identifiers alone is null); other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.sampling import sized
from weft.operators.components import connected_components
from weft.session import materialize, scratch

#: Costs of a signature (made, shuffled, sorted) and of a compared pair, in microseconds.
SIGNATURE_US, PAIR_US = 1.5, 0.005


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of a text, as a signed integer: XXH64 (seed 42) of every shingle, a bit is 1 if set in over half."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]]).tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(whole[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, n)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, fp) of each row."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def bit_statistics(points: DataFrame) -> tuple[np.ndarray, int]:
    """How many points have bits i and j (64 x 64, the diagonal: bit i alone), and the number of points."""

    def run(batches):
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int32()), pa.array(total.ravel())], ["cell", "n"])

    cells = points.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    both = np.zeros(4096, np.int64)
    for r in cells:
        both[r.cell] = r.n
    return both.reshape(64, 64), points.count()


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, correlated bits together: each group grows from a seed by its strongest tie."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, that add up to ``total`` at the least cost: dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for of in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in of.items():
                if spent + t not in step or cost + more < step[spent + t][0]:
                    step[spent + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def plan(points: DataFrame, distance: int, choices=(2, 3, 4, 5, 6), most: int | None = None, block_rows: int = 2048) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: the cheapest of all numbers of partitions in ``choices``.

    With ``most``, ``links`` deals no more than so many rows a point, copies for blocks of ``block_rows`` included: where no
    plan for ``distance`` keeps to that, it is the plan for the largest distance that does. More points have more pairs, and
    the cheapest plan evades pairs by ever more signatures; so without the bound, rows grow faster than points.
    """
    both, n = bit_statistics(points)
    grouped = {m: group_bits(both, n, m) for m in choices}
    values = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("sig")) for m, groups in grouped.items() for i, bits in enumerate(groups)]
    sizes = points.select(F.explode(F.array(*values)).alias("s")).groupBy("s.m", "s.i", "s.sig").agg(F.count(F.lit(1)).alias("c"))
    pairs = {(r.m, r.i): float(r.p) for r in sizes.groupBy("m", "i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("p")).collect()}  # a row a partition
    share = np.diag(both) / max(n, 1)
    differ = 2 * share * (1 - share)
    odds = differ / np.maximum(1 - differ, 1e-9)  # of two points: this bit differs, against not
    costs, rows = {m: [] for m in choices}, {}
    for m, groups in grouped.items():
        for i, bits in enumerate(groups):
            near, of = pairs.get((m, i), 0.0), {-1: 0.0}
            symmetric = [1.0] + [0.0] * len(bits)  # elementary symmetric sums: odds of k differing bits
            for b in bits:
                for k in range(len(bits), 0, -1):
                    symmetric[k] += symmetric[k - 1] * odds[b]
            for t in range(distance + 1):
                signatures = max(n, 1) * sum(comb(len(bits), k) for k in range(t + 1))
                # two points at distance t here meet at their own values and at others between
                candidates = near * sum(symmetric[: t + 1]) * (1 if t == 0 else 2)
                of[t] = SIGNATURE_US * signatures + PAIR_US * candidates
                rows[m, i, t] = signatures + 2 * candidates / block_rows
            costs[m].append(of)
    for d in range(distance, -1, -1):
        plans = []
        for m, groups in grouped.items():
            cost, thresholds = allocate(costs[m], d - m + 1)
            chosen = [(i, t) for i, t in enumerate(thresholds) if t >= 0]
            plans.append((cost, sum(rows[m, i, t] for i, t in chosen), [(groups[i], t) for i, t in chosen]))
        fit = [p for p in plans if most is None or p[1] <= most * max(n, 1)]
        if fit:
            return min(fit, key=lambda p: p[0])[2]
    return min(plans, key=lambda p: p[1])[2]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed fingerprints; bitwise_count of a negative number would count its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _pieces(block: np.ndarray, size: int):
    """The rows of a sorted block in pieces of about ``size``, never cutting between rows of one key."""
    at = 0
    while len(block) - at > size:
        same = np.flatnonzero((block[at + size :, 2:] != block[at + size - 1, 2:]).any(axis=1))
        to = at + size + (int(same[0]) if len(same) else len(block) - at - size)
        yield block[at:to]
        at = to
    if at < len(block):
        yield block[at:]


#: Rows of one key from which a key is compared as a matrix, and the rows of a matrix block.
MATRIX, BLOCK = 48, 256


def _near_pairs(keys: np.ndarray, fps: np.ndarray, distance: int):
    """(i, j, bits) of all pairs of rows that share a key (keys are sorted) and differ in at most ``distance`` bits, in pieces."""
    if not len(keys):
        return
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    end = np.append(start[1:], len(keys))
    long = end - start >= MATRIX
    for s, e in zip(start[long].tolist(), end[long].tolist()):
        own = fps[s:e].view(np.uint64)
        for i in range(0, e - s, BLOCK):
            bits = np.bitwise_count(own[i : i + BLOCK, None] ^ own[None, i:])
            hit = np.flatnonzero(bits <= distance)
            x, y = np.divmod(hit, bits.shape[1])
            upper = y > x
            yield x[upper] + (s + i), y[upper] + (s + i), bits.ravel()[hit[upper]]
    run_end = np.repeat(np.where(long, start, end), end - start)  # short runs: all rows against the next, the next but one ...
    at, step = np.arange(len(keys)), 1
    while len(at := at[at + step < run_end[at]]):
        bits = _differing(fps[at], fps[at + step])
        near = bits <= distance
        yield at[near], at[near] + step, bits[near]
        step += 1


def _forest(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id of its group) among rows that share a key; keys are sorted."""
    points, node = np.unique(ids, return_inverse=True)
    root = np.arange(len(points))
    for i, j, _ in _near_pairs(keys, fps, distance):
        a, b = root[node[i]], root[node[j]]
        while len(a := a[keep := a != b]):
            b = b[keep]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
            a, b = root[a], root[b]
    low = np.flatnonzero(root != np.arange(len(points)))
    return points[low], points[root[low]]


def links(points: DataFrame, distance: int, parts: list[tuple[list[int], int]], block_rows: int = 2048) -> DataFrame:
    """(a, b): a forest of all pairs of points (key, fp) that differ in at most ``distance`` bits, as keys.

    b is the smallest key of a's group in a task.
    """
    rows_at_once = 100_000  # a task holds only the groups of so many rows
    exact, near = [], []
    for i, (bits, t) in enumerate(parts):
        mask = F.lit(_mask(bits))
        for k in range(t + 1):
            for flips in combinations(bits, k):
                sig = F.col("fp").bitwiseXOR(F.lit(_mask(flips))).bitwiseAND(mask) if k else F.col("fp").bitwiseAND(mask)
                (near if k else exact).append(F.struct(F.lit(i).alias("part"), sig.alias("sig")))
    rows = points.select("key", "fp", F.explode(F.array(*exact, *near)).alias("s")).select("key", "fp", "s.part", "s.sig")
    large = materialize(rows.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block_rows), "signatures")
    n_large = large.count()
    if n_large:
        # at most rows / block_rows signatures: small enough to send out below 50,000, else joined by shuffle
        side = F.broadcast(large) if n_large <= 50_000 else large
        blocks = F.coalesce(F.ceil(F.col("c") / block_rows), F.lit(1)).cast("int")
        rows = rows.join(side, ["part", "sig"], "left").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
        rows = rows.select("key", "fp", "part", "sig", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
        rows = rows.select("key", "fp", "part", "sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    else:
        rows = rows.select("key", "fp", "part", "sig", F.lit(0).alias("x"), F.lit(0).alias("y"))
    # with the key last, a task sees its points in one order, whatever order they came in
    rows = rows.repartition("part", "sig", "x", "y").sortWithinPartitions("part", "sig", "x", "y", "key")

    def forest(block):
        keys, fps, ids = block[:, 2:], block[:, 1], block[:, 0]
        a, b = _forest(keys, fps, ids, distance)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(j)).astype(np.int64) for j in range(6)], axis=1))
            size += batch.num_rows
            if size >= rows_at_once:
                block = np.concatenate(held)
                other = np.flatnonzero((block[:, 2:] != block[-1, 2:]).any(axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last key may go on in the next batch
                for piece in _pieces(block[:cut], rows_at_once):
                    yield forest(piece)
                held, size = [block[cut:]], len(block) - cut
        if size:
            for piece in _pieces(np.concatenate(held), rows_at_once):
                yield forest(piece)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, block_rows: int = 2048) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id, component_size."""
    own = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    points = materialize(own.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "points")
    found = links(points.select(F.col("fp").alias("key"), "fp"), distance, plan(points, distance), block_rows)
    roots = materialize(connected_components(found), "roots")
    linked = points.join(roots, points["fp"] == roots["node"]).select("fp", "root", "first", "n")
    whole = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    linked = linked.join(whole, "root").select("fp", "component_id", "component_size")
    lone = points.join(roots, points["fp"] == roots["node"], "left_anti").select("fp", F.col("first").alias("component_id"), F.col("n").alias("component_size"))
    return own.join(linked.unionByName(lone), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def _slices(batches, rows: int):
    """The batches in pieces of at most ``rows`` rows, so that what is made of a row's text is held for so many at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _shingles(text: str | None, width: int) -> frozenset:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return frozenset(zip(*(words[i:] for i in range(width)))) if len(words) >= width else frozenset([tuple(words)])


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``_shingles``, sorted, each once."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    whole = b" ".join(words)
    n = len(words) - width + 1
    h = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([h(whole, 7)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    return np.unique(np.fromiter((h(whole[a:b], 7) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, n))


#: Bits of a parity sketch, and its 64-bit words. Two sets differ in no fewer elements than their sketches in bits.
SKETCH, SKETCH_WORDS = 1024, 16


def _sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _wide_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of four bits or more an element: it tells long texts apart, too."""
    return _sketch(hashes, max(SKETCH, 1 << (4 * len(hashes) - 1).bit_length()))


def _least_difference(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at least; the wider sketch is folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes in the order of all texts: two sets of Jaccard ``similarity`` or more share one of theirs.

    The order: by hash, but ``common`` (sorted) last and by ``rank``.
    """
    n = len(hashes)
    size = n - max(1, int(np.ceil(similarity * n - 1e-9))) + 1
    if not len(common):
        return hashes[:size]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    return np.concatenate([hashes[~last], hashes[last][np.argsort(rank[at[last]])]])[:size]


def _similar_pairs(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray, sketches: np.ndarray, similarity: float):
    """(i, j) of pairs of rows that share a key (keys are sorted), in pieces: all whose sets can be similar enough.

    A key is an element of both sets, and ``places`` has how many of the own elements come before it. Where the key is the
    first that both have, they share no more than what is left from there on in the smaller rest; so a similar pair passes
    at its first key, and with it sets of too different sizes fall out.
    """
    if not len(keys):
        return
    most = (1 - similarity) / (1 + similarity)  # of both sizes: elements that similar sets can differ in
    least = similarity / (1 + similarity)  # of both sizes: elements that similar sets share
    rest = sizes - places
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    end = np.append(start[1:], len(keys))
    long = end - start >= MATRIX
    for s, e in zip(start[long].tolist(), end[long].tolist()):
        for i in range(s, e, BLOCK):
            to = min(i + BLOCK, e)
            bits = np.zeros((to - i, e - i), np.int64)
            for w in range(SKETCH_WORDS):
                bits += np.bitwise_count(sketches[i:to, None, w] ^ sketches[None, i:e, w])
            both = sizes[i:to, None] + sizes[None, i:e]
            x, y = np.nonzero((bits <= most * both + 1e-6) & (np.minimum(rest[i:to, None], rest[None, i:e]) >= least * both - 1e-6))
            upper = y > x
            yield x[upper] + i, y[upper] + i
    run_end = np.repeat(np.where(long, start, end), end - start)
    at, step = np.arange(len(keys)), 1
    while len(at := at[at + step < run_end[at]]):
        both = sizes[at] + sizes[at + step]
        fit = at[np.minimum(rest[at], rest[at + step]) >= least * both - 1e-6]
        bits = np.bitwise_count(sketches[fit] ^ sketches[fit + step]).sum(axis=1, dtype=np.int64)
        near = fit[bits <= most * (sizes[fit] + sizes[fit + step]) + 1e-6]
        yield near, near + step
        step += 1


def _marks(hashes: DataFrame, bits: int = 25) -> np.ndarray:
    """A bit table, by the last ``bits`` of a hash (of prefixes, the first are mostly low), of the hashes (sig): 64-bit words, 4 MB with 25 bits, however many hashes."""
    slot = F.col("sig").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    found = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[np.asarray(found["word"], np.int64)] = np.asarray(found["bits"], np.int64).view(np.uint64)
    return table


def _marked(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """(key, root, place, sig) of the elements of the lists ``sigs`` of ``rows`` (key, root, sigs) whose bit is set: all hashes
    behind ``marks`` and few others, so that the others are not shuffled to be joined with nothing."""
    shared, last = rows.sparkSession.sparkContext.broadcast(marks), np.uint64(64 * len(marks) - 1)

    def run(batches):
        for batch in batches:
            sigs = batch.column(2).flatten()
            lengths = np.asarray(batch.column(2).value_lengths(), np.int64)
            slot = np.asarray(sigs, np.int64).view(np.uint64) & last
            keep = np.flatnonzero(shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
            row = np.repeat(np.arange(len(lengths)), lengths)[keep]
            place = keep - (np.cumsum(lengths) - lengths)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place.astype(np.int32)), sigs.take(pa.array(keep))], ["key", "root", "place", "sig"])

    return rows.select("key", "root", "sigs").mapInArrow(run, "key long, root long, place int, sig long")


def _candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of ``rows`` (key, root, n, place, sketch, sig, x, y): all pairs that share sig, x, y, can be similar and have two roots."""
    rows_at_once = 8_000  # a task holds all pairs of so many rows
    rows = rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y", "key")

    def pairs_of(block, sketch):
        points, node = np.unique(block[:, 0], return_inverse=True)
        found = []
        for i, j in _similar_pairs(block[:, 4:], block[:, 2], block[:, 3], sketch, similarity):
            apart = block[i, 1] != block[j, 1]
            if apart.any():
                a, b = node[i[apart]], node[j[apart]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        a, b = np.divmod(np.unique(pairs[0] * len(points) + pairs[1]), max(1, len(points)))
        return pa.RecordBatch.from_arrays([pa.array(points[a]), pa.array(points[b])], ["a", "b"])

    def pieces(block, sketch):
        at = 0
        for piece in _pieces(block[:, 2:], rows_at_once):
            yield pairs_of(block[at : at + len(piece)], sketch[at : at + len(piece)])
            at += len(piece)

    def run(batches):
        held, sketches, size = [], [], 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(j)).astype(np.int64) for j in range(7)], axis=1))
            sketches.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS))
            size += batch.num_rows
            if size >= rows_at_once:
                block, sketch = np.concatenate(held), np.concatenate(sketches)
                other = np.flatnonzero((block[:, 4:] != block[-1, 4:]).any(axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last key may go on in the next batch
                yield from pieces(block[:cut], sketch[:cut])
                held, sketches, size = [block[cut:]], [sketch[cut:]], len(block) - cut
        if size:
            yield from pieces(np.concatenate(held), np.concatenate(sketches))

    return rows.select("key", "root", "n", "place", "sig", "x", "y", "sketch").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common_shingles(texts: DataFrame, width: int, one_in: int = 20, least_rows: int = 4000, keep: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and ranks of shingles that many texts (_own, _text) have, from a sample of the texts (one in ``one_in``, about ``least_rows`` if there are fewer); ``keep`` at most.

    Only the order of shingles depends on them, and with it how many candidates there are, not which pairs are found.
    """

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_hashes(x.as_py(), width).view(np.int64))], ["hash"])

    part = min(one_in, max(1, texts.count() // least_rows))
    sample = texts.where(F.pmod(F.xxhash64("_own"), F.lit(part)) == 0).select("_text")
    got = sample.mapInArrow(run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").orderBy(F.desc("c"), "hash").limit(keep).toPandas()
    hashes = got["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order  # the most frequent last


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verify_width: int = 5, similarity: float = 0.8, distance: int = 10, block_rows: int = 1024, broadcast_rows: int = 100_000, forest_rounds: int = 1) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group of near copies, that with the smallest identifier.

    Two texts are linked if the Jaccard similarity of their ``verify_width``-word shingles, computed on the whole texts, is
    ``similarity`` or more; linked texts form a group, and so do rows of equal texts. The first round verifies links of
    fingerprints of these shingles within ``distance`` bits (a forest, as ``links`` gives it), which joins most copies; it
    deals ``ROWS_A_POINT`` rows a text at most. It need not find all, and near texts can lie further apart in bits, so the second round finds every other pair (but for collisions of 64-bit hashes):
    similar texts share one of the first shingles of each in an order of all shingles, rare ones first, and their parity
    sketches differ in no more bits than similar sets can in elements. Each text's nearest pair is verified first, in
    ``forest_rounds`` rounds, and then every pair whose ends are still apart, so the result depends neither on ``distance``
    nor on how rows are dealt.

    Equal texts are told by SHA-256 and length. Rows that repeat the identifier and text that stays, stay with it; if all
    identifiers of a group are null, all its rows stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own_text = F.concat(F.unhex(F.sha2(text, 256)), F.encode(F.octet_length(text).cast("string"), "UTF-8"))
    marked = docs.select(F.col(id_col).alias("_id"), own_text.alias("_own"), text.alias("_text"))
    with scratch(docs.sparkSession):
        gone = _dropped_copies(marked, verify_width, similarity, distance, block_rows, broadcast_rows, forest_rounds)
        gone = materialize(gone, "dropped", outlives=True)
    kept = docs.select(F.struct("*").alias("_row"), own_text.alias("_own"), F.col(id_col).alias("_id"))
    same = (F.col("_own") == F.col("_gone")) & F.col("_id").eqNullSafe(F.col("_gone_id"))
    return kept.join(sized(gone, broadcast_rows), same, "left_anti").select("_row.*")


#: Rows a text that the round of fingerprints deals at most: what it does not link, the shingles' round finds.
ROWS_A_POINT = 16


def _dropped_copies(marked: DataFrame, verify_width: int, similarity: float, distance: int, block_rows: int, broadcast_rows: int, forest_rounds: int) -> DataFrame:
    """(_gone, _gone_id): texts and identifiers of the rows of ``marked`` (_id, _own, _text) that do not stay."""
    spark = marked.sparkSession
    common = spark.sparkContext.broadcast(_common_shingles(marked.select("_own", "_text"), verify_width))  # 200,000 hashes and ranks at most

    def prefixes(batches):
        for batch in _slices(batches, 500):
            hashes = [_shingle_hashes(x, verify_width) for x in batch.column(2).to_pylist()]
            first = [_prefix(h, *common.value, similarity).view(np.int64) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(h) for h in hashes], pa.int64()), pa.array([_majority(h) for h in hashes], pa.int64()), pa.array([_sketch(h) for h in hashes], pa.binary()),
                 pa.array([_wide_sketch(h) for h in hashes], pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["id", "own", "n", "fp", "sketch", "wide", "sigs"])

    schema = T.StructType([T.StructField("id", marked.schema["_id"].dataType), T.StructField("own", T.BinaryType())])
    for name, kind in (("n", T.LongType()), ("fp", T.LongType()), ("sketch", T.BinaryType()), ("wide", T.BinaryType()), ("sigs", T.ArrayType(T.LongType()))):
        schema.add(name, kind)
    rows = marked.select("_id", "_own", "_text").mapInArrow(prefixes, schema).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "prefixes")  # a written table: a row keeps its number
    # a point is a text, and its key the number of its first row
    texts = materialize(rows.groupBy("own").agg(F.min("row").alias("key"), F.count(F.lit(1)).alias("c")), "texts")
    repeated = texts.where("c > 1")
    if repeated.isEmpty():
        points, members = rows.withColumnRenamed("row", "key"), rows.select(F.col("row").alias("key"), "own", "id")
    else:
        copies = rows.select("own", "id", "row").join(repeated, "own", "left")
        members = copies.select(F.coalesce("key", "row").alias("key"), "own", "id")
        points = materialize(rows.join(texts.select(F.col("key").alias("row")), "row", "left_semi").withColumnRenamed("row", "key"), "points")

    def verify(batches):
        for batch in _slices(batches, 200):
            keep, held = [], {}
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.as_py(), y.as_py()
                held = {t: held[t] if t in held else _shingles(t, verify_width) for t in (x, y)}  # the pair before often has one of them
                both = len(held[x] & held[y])
                keep.append(both >= similarity * (len(held[x]) + len(held[y]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    most = (1 - similarity) / (1 + similarity)

    def possible(batches):
        for batch in _slices(batches, 500):
            columns = zip(*(batch.column(j).to_pylist() for j in range(2, 6)))
            far = [(max(abs(n - m), _least_difference(x, y)) / max(1, n + m), n + m) for n, x, m, y in columns]
            keep = [d * size <= most * size + 1e-6 for d, size in far]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in far], pa.float64())], ["a", "b", "far"]).filter(pa.array(keep, pa.bool_()))

    def possible_pairs(candidates):
        """(a, b, far): the pairs whose wide sketches allow the similarity, and the least part of their elements that differs."""
        wide = points.select("key", "n", "wide")
        candidates = candidates.join(wide.toDF("a", "n", "x"), "a").join(wide.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
        return materialize(candidates.mapInArrow(possible, "a long, b long, far double"), "possible")

    def verified(pairs):
        ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        with scratch(spark):
            named = materialize(points.select("key", F.col("own").alias("_own")).join(sized(ends, broadcast_rows), "key", "left_semi"), "ends")
            wanted = marked.select("_own", "_text").join(sized(named, broadcast_rows), "_own").select("key", "_text")
            wanted = materialize(wanted if repeated.isEmpty() else wanted.dropDuplicates(["key"]), "texts")
            both = pairs.select("a", "b").join(wanted.toDF("a", "x"), "a").join(wanted.toDF("b", "y"), "b")
            return materialize(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "verified", outlives=True)

    def components(edges):
        with scratch(spark):
            return materialize(connected_components(edges), "roots", outlives=True)

    prints = points.select("key", "fp")
    near = links(prints, distance, plan(prints, distance, most=ROWS_A_POINT))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = verified(possible_pairs(materialize(near, "candidates")))
    joined = components(linked)
    # of shingles that several texts have first, only those are left that texts of two groups have
    named = points.select("key", "sigs").join(sized(joined, broadcast_rows), F.col("key") == F.col("node"), "left")
    sigs = named.select("key", F.coalesce("root", "key").alias("root"), F.posexplode("sigs").alias("place", "sig"))
    shared = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    shared = materialize(shared.select("sig", F.ceil(F.col("c") / block_rows).cast("int").alias("nb")), "signatures")
    cells = _marked(named.select("key", F.coalesce("root", "key").alias("root"), "sigs"), _marks(shared))
    cells = cells.join(sized(shared, broadcast_rows), "sig").withColumn("own", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    cells = cells.select("key", "root", "place", "sig", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    cells = cells.select("key", "root", "place", "sig", F.least("own", "other").cast("long").alias("x"), F.greatest("own", "other").cast("long").alias("y"))
    rest = materialize(_candidates(cells.join(points.select("key", "n", "sketch"), "key"), similarity), "candidates")
    rest, roots = possible_pairs(rest), joined
    for last in (False,) * forest_rounds + (True,):
        ends = [roots.select(F.col("node").alias(e), F.col("root").alias(f"r{e}")) for e in "ab"]
        rest = rest.join(sized(ends[0], broadcast_rows), "a", "left").join(sized(ends[1], broadcast_rows), "b", "left")
        rest = materialize(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "far"), "apart")
        if rest.isEmpty():
            break
        if last:
            chosen = rest
        else:
            # the nearest pair of every text: at most a pair a text, and they join most groups whole
            ways = rest.select(F.col("a").alias("v"), "far", "a", "b").unionByName(rest.select(F.col("b").alias("v"), "far", "a", "b"))
            chosen = materialize(ways.groupBy("v").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "nearest")
        linked = linked.unionByName(verified(chosen))
        roots = components(linked)
        rest = rest.join(sized(chosen.select("a", "b"), broadcast_rows), ["a", "b"], "left_anti")
    grouped = members.join(roots, members["key"] == roots["node"]).select("own", "id", "root") if repeated.isEmpty() else members.join(roots, members["key"] == roots["node"], "left").select("own", "id", F.coalesce("root", "key").alias("root"))
    stays = grouped.groupBy("root").agg(F.min("id").alias("stays"))
    return grouped.join(stays, "root").where(F.col("stays").isNotNull() & ~F.col("id").eqNullSafe(F.col("stays"))).select(F.col("own").alias("_gone"), F.col("id").alias("_gone_id")).distinct()
