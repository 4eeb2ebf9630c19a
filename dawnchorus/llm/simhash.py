"""SimHash classes of result texts, found with vantage-point trees over Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.shared import connected, durable, mapped

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
# Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 1 << 16
# Fingerprints read to choose the vantage points of the shards; every fingerprint is indexed.
TREE_SAMPLE = 1 << 14
# Fingerprints that a shard holds on average, and the deepest division into shards.
SHARD_SIZE = 1 << 15
MAX_DEPTH = 12
# Fingerprints compared outright at the foot of a tree.
LEAF = 192


def fingerprint(text: str | None) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' hashes.

    Shingles are three words in a row, repeats included, joined by spaces; with fewer words the whole
    sequence is one; without words the fingerprint is 0. Words are what ASCII white space separates,
    with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE], strict=True)
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in spans])
        set_bits += _bit_counts(np.frombuffer(hashes, dtype=">u8"))
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, the highest first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(results: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """(file, bits) of every result file; ``bits`` is the fingerprint as a signed long."""
    kind = results.schema[file].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            bits = pa.array(found.view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["file", "bits"])

    return mapped(results.select(file, content), run, f"file {kind.simpleString()}, bits long")


def _distance(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point)


def _split(values: np.ndarray, draw: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point and the radius that halves the values best, of a few tried points.

    Both sides hold something: the point itself is at distance 0, and the radius is below the largest.
    """
    best = None
    for point in values[draw.integers(0, len(values), 5)]:
        far = np.bincount(_distance(values, point), minlength=65)
        inside = np.cumsum(far)[: np.flatnonzero(far)[-1]]
        radius = int(np.argmin(np.abs(inside - len(values) / 2)))
        uneven = abs(int(inside[radius]) * 2 - len(values))
        if best is None or uneven < best[0]:
            best = (uneven, point, radius)
    return best[1], best[2]


def shard_tree(sample: np.ndarray, depth: int) -> list[tuple[int, np.uint64, int]]:
    """Vantage points of the shards: (node, point, radius), children of n are 2n and 2n + 1."""
    draw = np.random.default_rng(11)
    tree, level = [], [(1, np.unique(sample))]
    for _ in range(depth):
        below = []
        for node, values in level:
            if len(values) < 2:
                continue
            point, radius = _split(values, draw)
            tree.append((node, point, radius))
            inside = _distance(values, point) <= radius
            below += [(2 * node, values[inside]), (2 * node + 1, values[~inside])]
        level = below
    return tree


def route(
    bits: np.ndarray, tree: list[tuple[int, np.uint64, int]], distance: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every place where a fingerprint is stored or asked for.

    A fingerprint is stored once, on its side of every vantage point. By the triangle inequality a
    neighbour can only be across a boundary that is at most ``distance`` away. A stored one near
    it asks the outer side; one that only asks goes wherever an answer may be. So each pair
    meets exactly once, in the shard of one of the two.
    """
    rows, nodes = np.arange(len(bits)), np.ones(len(bits), dtype=np.int64)
    home = np.ones(len(bits), dtype=bool)
    for node, point, radius in tree:
        here = np.flatnonzero(nodes == node)
        if not len(here):
            continue
        far = _distance(bits[rows[here]], point).astype(np.int64)
        inner = np.where(home[here], far <= radius, far <= radius + distance)
        outer = np.where(home[here], far > radius, far > radius - distance)
        asks = home[here] & inner & (far > radius - distance)
        both = here[(inner & outer) | asks]
        nodes[here] = np.where(inner, 2 * node, 2 * node + 1)
        # The second place of those that go both ways only asks.
        rows = np.r_[rows, rows[both]]
        nodes = np.r_[nodes, np.full(len(both), 2 * node + 1)]
        home = np.r_[home, np.zeros(len(both), dtype=bool)]
    return rows, nodes, home


def links(stored: np.ndarray, asking: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``distance``: of two stored ones, or of an asking (counted behind) and a stored one."""
    draw = np.random.default_rng(5)
    values = np.r_[stored, asking]
    work = [(np.arange(len(stored)), np.arange(len(stored), len(values)))]
    while work:
        own, other = work.pop()
        if not len(own):
            continue
        if len(own) <= LEAF:
            a, b = np.nonzero(np.bitwise_count(values[own][:, None] ^ values[own][None, :]) <= distance)
            yield own[a[a < b]], own[b[a < b]]
            for at in range(0, len(other), 4096):
                some = other[at : at + 4096]
                a, b = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[own][None, :]) <= distance)
                yield some[a], own[b]
            continue
        point, radius = _split(values[own], draw)
        far = _distance(values[own], point).astype(np.int64)
        far_other = _distance(values[other], point).astype(np.int64)
        inside = far <= radius
        asks = own[inside & (far > radius - distance)]
        work.append((own[inside], other[far_other <= radius + distance]))
        work.append((own[~inside], np.r_[other[far_other > radius - distance], asks]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the pairs, which are folded in one by one."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(root[a], root[b])
            high = np.maximum(root[a], root[b])
            differ = low < high
            if not differ.any():
                break
            a, b, low, high = a[differ], b[differ], low[differ], high[differ]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def near_links(classes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (u, v) that join all classes (rep, bits; bits distinct) within ``distance`` bits.

    Not every pair: each shard returns a forest that connects the same classes, so that
    thousands of close fingerprints don't become millions of rows.
    """
    spark = classes.sparkSession
    rows = classes.count()
    depth = int(np.clip(np.ceil(np.log2(max(1, rows / SHARD_SIZE))), 3, MAX_DEPTH))
    drawn = classes.orderBy(F.xxhash64("bits")).limit(TREE_SAMPLE).select("bits").collect()
    tree = shard_tree(np.array([r[0] for r in drawn], dtype=np.int64).view(np.uint64), depth)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            at, shard, home = route(bits.view(np.uint64), shared.value, distance)
            columns = [batch.column(0).take(pa.array(at)), pa.array(bits[at]), pa.array(shard), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "bits", "shard", "home"])

    kind = classes.schema["rep"].dataType.simpleString()
    placed = mapped(classes.select("rep", "bits"), place, f"rep {kind}, bits long, shard long, home boolean")

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("home", ascending=False, kind="stable")
        bits = shard["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        stored = int(shard["home"].sum())
        root = _roots(len(bits), links(bits[:stored], bits[stored:], distance))
        found = np.flatnonzero(root != np.arange(len(bits)))
        names = shard["rep"].to_numpy()
        return pd.DataFrame({"u": names[found], "v": names[root[found]]})

    return placed.groupBy("shard").applyInPandas(search, f"u {kind}, v {kind}")


def near_duplicate_classes(
    results: DataFrame, file: str = "file", content: str = "content", distance: int = MAX_DISTANCE
) -> DataFrame:
    """Class of every result file among those with nearly the same text.

    Returns one row per input row: the key ``file``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest key reachable over links of at most ``distance`` differing bits, itself included.
    Equal fingerprints fold into one before anything is compared, however many files share them;
    distinct ones are stored in the shards of a vantage-point tree and searched exactly (``route``,
    ``links``). Shards are as even as the tree's bounded sample makes them; they hold 17 bytes a row.

    Files with a null text, or without words, have fingerprint 0 and are linked like any other. Rows
    with a null key get the class of their fingerprint (null if all of it have none). Repeated rows
    and keys keep a row each; further columns are ignored.
    """
    marks = durable(fingerprints(results, file, content))
    classes = durable(marks.groupBy("bits").agg(F.min("file").alias("rep")))
    known = classes.where("rep IS NOT NULL")
    # A key on several texts is one node: its classes are one component.
    roots = connected(near_links(known, distance))
    classes = (
        classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("bits").alias("own"), F.coalesce("root", "rep").alias("component_id"))
    )
    classes = durable(classes)
    return marks.join(classes, F.col("bits") == F.col("own"), "left").select(
        F.col("file").alias(file),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(results: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """The rows of one result file of every class: the one with the smallest key, with all their columns.

    Rows without a key cannot be told apart: they stay if any of them is in a class without keys.
    """
    classes = near_duplicate_classes(results, file, content)
    first = classes.where(F.col(file).eqNullSafe(F.col("component_id")))
    first = first.select(F.col(file).alias("__first__")).distinct()
    return results.join(first, F.col(file).eqNullSafe(F.col("__first__")), "left_semi")
