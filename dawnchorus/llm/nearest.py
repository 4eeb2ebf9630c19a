"""The segments whose embeddings have the largest inner products with those of given segments, exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.shared import durable, mapped

# Vectors of one block of segments, and of one block of queries.
BLOCK, QUERY_BLOCK = 4096, 8192
# A block of wide vectors ends when its rows have this many bytes.
BLOCK_BYTES = 16 << 20
# Query rows of a block that are compared at once.
QUERY_STEP = 1024
# Vectors that place the axes and the first bounds; results do not depend on them.
SAMPLE_VECTORS, SAMPLE_BYTES = 16_384, 16 << 20
# Bytes of query vectors that are broadcast at once.
ROUND_BYTES = 64 << 20
# Share of the squared length that the first axes must hold.
FIRST_ENERGY = 0.6
# Relative error allowed for in bounds of single precision.
SLACK = 1e-4
# Beyond this share of surviving pairs one product of all is cheaper than picking them.
DENSE = 0.05
# Integers up to here are exact in double precision.
EXACT = float(1 << 53)
LIMIT = 1 << 62
# Products of lengths beyond this leave single precision; nothing is pruned there.
HUGE = 1e36


def _integers(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null where a component is null or not finite, or there is no vector."""
    usable = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    grown = F.transform(
        embedding,
        lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT))).cast("long"),
    )
    return F.when(usable, grown)


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _padded(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    matrix = np.zeros((len(sizes), width), np.int64)
    matrix[np.arange(width) < sizes[:, None]] = flat
    return matrix


def _packed(matrix: np.ndarray) -> bytes:
    """Integers of four bytes where they fit, and their size in front."""
    small = np.abs(matrix).max(initial=0) < 1 << 31
    return (b"4" if small else b"8") + matrix.astype(np.int32 if small else np.int64).tobytes()


def _matrix(data: bytes, rows: int) -> np.ndarray:
    size = int(data[:1])
    return np.frombuffer(data, f"i{size}", offset=1).reshape(rows, (len(data) - 1) // size // rows).astype(np.int64)


def _blocks(vectors: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """Consecutive rows (vec, length, *keys*) of a partition as blocks: a matrix and lists of keys.

    ``order`` ranks the rows of a block by their smallest key.
    """
    kinds = {k: vectors.schema[k].dataType.simpleString() for k in keys}

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n = rows.num_rows
        matrix = _padded(rows["vec"].combine_chunks() if n else rows["vec"])
        lengths = rows["length"].to_numpy()
        one = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(one, rows[k].combine_chunks()) for k in keys]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([float(lengths.max())]),
                pa.array([n], pa.int32()),
                pa.array([_packed(matrix)], pa.binary()),
                pa.array([lengths.astype(np.float64).tobytes()], pa.binary()),
                *lists,
            ],
            names=["longest", "n", "matrix", "lengths", *keys],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = weight = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                held.append(part)
                count += part.num_rows
                weight += part.nbytes
                batch = batch.slice(part.num_rows)
                if count == size or weight >= BLOCK_BYTES:
                    yield block(pa.Table.from_batches(held))
                    held, count, weight = [], 0, 0
        if count:
            yield block(pa.Table.from_batches(held))

    schema = "longest double, n int, matrix binary, lengths binary"
    schema += "".join(f", `{k}` array<{kind}>" for k, kind in kinds.items())
    return mapped(vectors.select("vec", "length", *keys), run, schema)


class Axes:
    """An orthogonal basis whose first axes hold most of a sample's squared length, and the sample itself."""

    def __init__(self, sample: np.ndarray):
        self.sample = sample
        data = sample.astype(np.float64)
        width = data.shape[1]
        # The right singular vectors of the sample, from its Gram matrix.
        values, vectors = np.linalg.eigh(data.T @ data)
        values, vectors = values[::-1], vectors[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        first = int(np.searchsorted(share, FIRST_ENERGY)) + 1
        first = min(max(first, -(-width // 8)), max(1, width // 2)) if width else 0
        self.first = np.ascontiguousarray(vectors[:, :first]) if width else np.zeros((0, 0))

    def partial(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates on the first axes, and the length of what is left."""
        shared = min(rows.shape[1], self.first.shape[0])
        on = rows[:, :shared].astype(np.float64) @ self.first[:shared]
        rest = np.sqrt(np.maximum(lengths**2 - (on * on).sum(axis=1), 0.0))
        return on.astype(np.float32), rest.astype(np.float32)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, or of all rows where ``b`` is transposed by the caller: exact integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if bound < EXACT:
        return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=1).astype(np.int64)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(min(int(x), (1 << 63) - 1), -(1 << 63)) for x in exact], np.int64)


def _all_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.stack([_products(np.broadcast_to(row, b.shape), b) for row in a]) if len(a) else np.zeros((0, len(b)))


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing components are zero, so those that only one side has add nothing."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def kth_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of every row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(np.float64)


class Searcher:
    """What one task knows of a query block: the best scores so far bound what may still count."""

    def __init__(self, queries: np.ndarray, lengths: np.ndarray, floor: np.ndarray, axes: Axes, k: int):
        self.queries, self.lengths, self.axes, self.k = queries, lengths, axes, k
        self.on, self.rest = axes.partial(queries, lengths)
        self.best = np.full((len(queries), k), -np.inf)
        self.floor = floor.copy()

    def survivors(self, at: slice, rows: np.ndarray, lengths: np.ndarray, on: np.ndarray, rest: np.ndarray):
        """(query, row, score) of the pairs of these queries whose score reaches the floor of the query."""
        floor, size = self.floor[at], self.lengths[at]
        # Rows are sorted by falling length: behind the last that any query can use, none is used.
        reach = np.where(size > 0, floor - SLACK * np.abs(floor), 0.0) / np.maximum(size, 1e-300)
        live = np.flatnonzero((reach <= lengths[0] * (1 + SLACK)) | (size == 0) & (floor <= 0))
        if not len(live):
            return None
        least = reach[live].min()
        until = int(np.searchsorted(-lengths, -least * (1 - np.sign(least) * SLACK), "right")) if least > 0 else len(lengths)
        if not until:
            return None
        ask = live + (at.start or 0)
        # Cauchy-Schwarz: what the other axes add is at most the product of the lengths that are left.
        bound = self.on[ask] @ on[:until].T + np.outer(self.rest[ask], rest[:until])
        if self.lengths[ask].max() * lengths[0] > HUGE:
            bound[:] = np.inf
        slack = (SLACK * np.outer(self.lengths[ask], lengths[:until])).astype(np.float32)
        passes = bound + slack >= self.floor[ask].astype(np.float32)[:, None] - SLACK * np.abs(self.floor[ask])[:, None]
        if np.count_nonzero(passes) > DENSE * passes.size:
            a, b = _common(self.queries[ask], rows[:until])
            scores = _all_products(a, b)
            q, row = np.nonzero(passes & (scores >= self.floor[ask][:, None]))
            return ask[q], row, scores[q, row].astype(np.int64)
        q, row = np.nonzero(passes)
        a, b = _common(self.queries, rows)
        scores = _products(a[ask[q]], b[row])
        good = scores >= self.floor[ask[q]]
        return ask[q[good]], row[good], scores[good]

    def search(self, rows: np.ndarray, lengths: np.ndarray, order: np.ndarray):
        """(query, row, score) of the ``k`` best of every query in this block, as far as they may count.

        Equal scores keep the rows whose keys come first (``order``).
        """
        on, rest = self.axes.partial(rows, lengths)
        for low in range(0, len(self.queries), QUERY_STEP):
            found = self.survivors(slice(low, min(low + QUERY_STEP, len(self.queries))), rows, lengths, on, rest)
            if found is None or not len(found[0]):
                continue
            q, row, score = found
            ranked = np.lexsort((order[row], -score, q))
            q, row, score = q[ranked], row[ranked], score[ranked]
            begins = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
            kept = place < self.k
            q, row, score, place = q[kept], row[kept], score[kept], place[kept]
            some, which = np.unique(q, return_inverse=True)
            fresh = np.full((len(some), self.k), -np.inf)
            fresh[which, place] = score
            merged = np.concatenate([self.best[some], fresh], axis=1)
            self.best[some] = np.partition(merged, self.k, axis=1)[:, self.k :]
            self.floor[some] = np.maximum(self.floor[some], self.best[some].min(axis=1))
            yield q, row, score


def _sampled(blocks: DataFrame, width: int) -> np.ndarray:
    """About SAMPLE_VECTORS different vectors (SAMPLE_BYTES), evenly spaced in each block."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, max(64, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * max(1, width)))) / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # A block's share is rounded up or down by its content.
                some = min(n, int(n * share + zlib.crc32(data) / (1 << 32)))
                rows = _matrix(data, n)[np.arange(some) * n // max(1, some)] if some else None
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([some], pa.int32()), pa.array([_packed(rows)], pa.binary())], names=["n", "matrix"])

    found = [_matrix(bytes(r["matrix"]), r["n"]) for r in mapped(blocks.select("n", "matrix"), run, "n int, matrix binary").collect()]
    sample = np.zeros((sum(map(len, found)), width), np.int64)
    at = 0
    for rows in found:
        sample[at : at + len(rows), : rows.shape[1]] = rows
        at += len(rows)
    return sample


def similar_segments(
    segments: DataFrame,
    queries: DataFrame,
    k: int = 10,
    keys: Sequence[str] = ("file", "seg_idx"),
    embedding: str = "embedding",
    scale: float = 1024.0,
) -> DataFrame:
    """The ``k`` segments with the largest inner products of embeddings for every query segment, exactly.

    ``segments`` and ``queries`` have the ``keys`` that name a segment, and its ``embedding``, as ``classify_embeddings``
    takes them. Components become floor(scale * x), so that scores are exact integers. A query's own segment, the one
    of the same keys, is no result of it. Returns ``query_<key>`` for each key, ``rank`` (from 1), the keys and ``score``
    (long); equal scores are ranked by the smaller keys; a query with fewer candidates gets all of them.

    Null embeddings and those with a null or non-finite component take no part, nor do rows with a null key. Shorter vectors
    count as followed by zeros. Rows equal in keys and embedding count once. Components beyond 2**62 count as that, scores
    beyond a long as its limit. Further columns are ignored; empty tables give no rows.

    Equal vectors are folded first, with the smallest keys that may be results. The others are sorted by falling length and
    packed into blocks. Their coordinates on the first axes of an orthogonal basis give partial sums, and what the other
    axes can add is bounded by the lengths that are left; only pairs that may still be among the best are scored.
    The basis and the first bounds come from a bounded sample of vectors (SAMPLE_VECTORS); results do not depend on it. Queries are
    broadcast in rounds of bounded bytes, so every pair of blocks meets in some task and nothing is shuffled per pair.
    """
    spark = segments.sparkSession
    named = [f"key{i}" for i in range(len(keys))]

    def usable(rows: DataFrame) -> DataFrame:
        picked = rows.select(*[F.col(c).alias(n) for c, n in zip(keys, named)], _integers(F.col(embedding), scale).alias("vec"))
        return picked.dropna(subset=[*named, "vec"])

    # A query sees at most k of equal vectors, and one more that may be itself.
    by_key = Window.partitionBy("vec").orderBy(*named)
    first = usable(segments).withColumn("place", F.dense_rank().over(by_key)).where(F.col("place") <= k + 1)
    folded = first.groupBy("vec").agg(F.array_sort(F.collect_set(F.struct(*named))).alias("same")).withColumn("length", _length(F.col("vec")))
    asked = usable(queries).withColumn("query", F.md5(F.array_join(F.col("vec").cast("array<string>"), ",")))
    asked = durable(asked.select("query", "vec", *named))
    distinct = asked.groupBy("query").agg(F.first("vec").alias("vec")).withColumn("length", _length(F.col("vec")))
    keep = k + 1
    spread = folded.repartitionByRange(F.desc("length"), F.xxhash64("vec")).sortWithinPartitions(F.desc("length"), "same")
    blocks = durable(_blocks(spread, BLOCK, ["same"]))
    width = blocks.agg(F.max((F.octet_length("matrix") - 1) / F.substring("matrix", 1, 1).cast("string").cast("int") / F.col("n"))).first()[0]
    axes = spark.sparkContext.broadcast(Axes(_sampled(blocks, int(width or 0))))
    n_queries, q_width = distinct.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    per_block = max(1, min(QUERY_BLOCK, ROUND_BYTES // (8 * max(1, q_width or 0))))
    packed = _blocks(distinct.repartition(max(1, -(-n_queries // per_block))), per_block, ["query"])
    packed = durable(packed.withColumn("block", F.monotonically_increasing_id()))
    per_round = max(1, ROUND_BYTES // (8 * per_block * max(1, q_width or 0)))
    names = sorted(r["block"] for r in packed.select("block").collect())
    best = None
    for low in range(0, len(names), per_round):
        some = names[low : low + per_round]
        side = packed.where(F.col("block").isin(some)).select(
            F.col("block"), F.col("n").alias("q_n"), F.col("matrix").alias("q_matrix"), F.col("lengths").alias("q_lengths"), "query"
        )
        dealt = blocks.withColumn("block", F.explode(F.array(*[F.lit(b) for b in some])))
        found = _searched(dealt.join(F.broadcast(side), "block"), axes, keep)
        kept = durable(found) if len(names) > per_round else found
        best = kept if best is None else best.unionByName(kept)
    same = segments.schema
    shown = [*[f"query_{c}" for c in keys], "rank", *keys, "score"]
    if best is None:
        fields = [*[(f"query_{c}", same[c].dataType.simpleString()) for c in keys], ("rank", "int")]
        fields += [(c, same[c].dataType.simpleString()) for c in keys] + [("score", "long")]
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in fields))
    rows = best.select("query", "score", F.explode("same").alias("other"))
    along = Window.partitionBy("query").orderBy(F.desc("score"), "other")
    limited = rows.withColumn("place", F.row_number().over(along)).where(F.col("place") <= keep).drop("place")
    mine = F.struct(*named)
    pairs = asked.select("query", mine.alias("mine")).distinct().join(limited, "query").where(F.col("mine") != F.col("other"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("mine").orderBy(F.desc("score"), "other")))
    columns = [F.col(f"mine.{n}").alias(f"query_{c}") for n, c in zip(named, keys)]
    columns += ["rank", *[F.col(f"other.{n}").alias(c) for n, c in zip(named, keys)], "score"]
    return ranked.where(F.col("rank") <= k).select(*columns).select(*[f"`{c}`" for c in shown])


def _searched(pairs: DataFrame, axes, keep: int) -> DataFrame:
    """(query, score, same) of the pairs of blocks; a task meets blocks by falling length and remembers the best scores."""
    kind = pairs.schema["same"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Searcher] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                at = row["block"].as_py()
                if at not in known:
                    known[at] = _searcher(row, axes.value, keep)
                searcher = known[at]
                n = row["n"].as_py()
                matrix = _matrix(row["matrix"].as_py(), n)
                lengths = np.frombuffer(row["lengths"].as_py(), np.float64)
                same, queries = row["same"].values, row["query"].values
                smallest = pc.list_element(same, 0)
                fields = [pc.struct_field(smallest, [f]) for f in range(smallest.type.num_fields)]
                table = pa.Table.from_arrays(fields, names=[str(f) for f in range(len(fields))])
                by_key = pc.sort_indices(table, [(name, "ascending") for name in table.column_names]).to_numpy()
                order = np.empty(n, np.int64)
                order[by_key] = np.arange(n)
                for q, hit, score in searcher.search(matrix, lengths, order):
                    yield pa.RecordBatch.from_arrays(
                        [queries.take(pa.array(q)), pa.array(score, pa.int64()), same.take(pa.array(hit))],
                        names=["query", "score", "same"],
                    )

    return mapped(pairs, run, f"query string, score long, same {kind}")


def _searcher(row: dict, axes: Axes, keep: int) -> Searcher:
    """Starts with the scores that the sample's vectors reach: they are segments too."""
    n = row["q_n"].as_py()
    queries = _matrix(row["q_matrix"].as_py(), n)
    lengths = np.frombuffer(row["q_lengths"].as_py(), np.float64)
    floor = np.empty(n)
    for low in range(0, n, QUERY_STEP):
        a, b = _common(queries[low : low + QUERY_STEP], axes.sample)
        floor[low : low + QUERY_STEP] = kth_largest(_all_products(a, b), keep)
    return Searcher(queries, lengths, floor, axes, keep)
