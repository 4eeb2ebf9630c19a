"""Prefix trie of recordings by the calls they begin with, and totals of its subtrees rolled up in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.shared import durable, mapped

# Depths of one band: a node adds to at most so many ancestors in a round.
BAND_HEIGHT = 16
# Characters of keys that a row of the digest's last step carries.
CHUNK_CHARS = 1 << 20
_HASH = "decimal(38,0)"


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node; ``ends``: the node (its id) at which each recording's calls end."""

    nodes: DataFrame
    ends: DataFrame


def _carried(rows: DataFrame, file: str, sums: dict[str, Column]) -> DataFrame:
    """What earlier partitions hold of a recording that goes over a partition's edge, and whether later ones go on.

    In a range partitioning by recording only the first and the last recording of a partition do that, so there are
    at most two rows per partition.
    """
    totals = rows.groupBy(file, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    along = Window.partitionBy(file).orderBy("_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.select(
            F.col(file).alias("_file"),
            F.col("_part").alias("_at"),
            *[F.sum(n).over(before).alias(f"{n}_before") for n in sums],
            F.lead("_part").over(along).isNotNull().alias("_more"),
        )
        .where(F.col("_more") | F.col(f"{next(iter(sums))}_before").isNotNull())
    )


def _with_carried(rows: DataFrame, carried: DataFrame, file: str) -> DataFrame:
    known = (F.col(file) == F.col("_file")) & (F.col("_part") == F.col("_at"))
    return rows.join(F.broadcast(carried), known, "left").drop("_file", "_at")


def in_order(rows: DataFrame, file: str, order: Sequence[Column], name: str) -> DataFrame:
    """1-based place of every row among those of its recording; rows that ``order`` cannot tell apart take any order.

    Rows are range-partitioned by recording and order, so that one with very many rows, or piles of equal
    rows, spread over partitions; each counts its own rows and adds those of earlier partitions. Adds ``_part``.
    """
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(F.col(file), *order, F.col("_row")).drop("_row")
    placed = durable(spread.withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy(file, "_part").orderBy(*order)))
    carried = _carried(placed, file, {"_n": F.count(F.lit(1))}).drop("_more")
    whole = _with_carried(local, carried, file)
    place = F.col("_local").cast("long") + F.coalesce("_n_before", F.lit(0))
    return whole.withColumn(name, place).drop("_local", "_n_before")


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits."""
    digest = F.sha2(text, 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast(_HASH) for at in (1, 16))


def _node(depth: Column, a: Column, b: Column) -> Column:
    """Id of a node: the digest of its depth and of the sums of its steps' hashes."""
    return F.unhex(F.md5(F.concat_ws(".", depth.cast("string"), a.cast("string"), b.cast("string"))))


def _root() -> Column:
    return _node(F.lit(0), F.lit(0), F.lit(0))


def _steps(calls: DataFrame) -> DataFrame:
    """(file, depth, node, parent, chars, ends) of every call.

    A node is the sequence of the first calls. Every call's hash covers its place, name and text, so the sum of the
    hashes of a sequence stands for it (120 bits), and is a prefix sum that partitions can share out.
    """
    size = F.concat_ws(":", F.length("name").cast("string"), F.length("label").cast("string"))
    digest = F.sha2(F.concat(size, F.lit(":"), F.col("name"), F.col("label")), 256)
    narrow = calls.select("file", "at", digest.alias("step"), F.length("label").cast("long").alias("chars"))
    placed = in_order(narrow, "file", [F.col("at").asc_nulls_first(), F.col("step")], "depth")
    a, b = _hashes(F.concat_ws(".", F.col("depth").cast("string"), F.col("step")))
    hashed = placed.select("file", "_part", "depth", "chars", a.alias("a"), b.alias("b"))
    inside = Window.partitionBy("file", "_part").orderBy("depth")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_a": F.sum("a").cast(_HASH), "_b": F.sum("b").cast(_HASH)}
    carried = _carried(hashed, "file", sums)
    summed = hashed.select(
        "*",
        F.sum("a").over(upto).cast(_HASH).alias("sa"),
        F.sum("b").over(upto).cast(_HASH).alias("sb"),
        F.lead("depth").over(inside).isNull().alias("last"),
    )
    whole = _with_carried(summed, carried, "file")
    zero = F.lit(0).cast(_HASH)
    sa, sb = ((F.col(f"s{x}") + F.coalesce(f"_{x}_before", zero)).cast(_HASH) for x in "ab")
    d = F.col("depth")
    before = [(s - F.col(x)).cast(_HASH) for s, x in ((sa, "a"), (sb, "b"))]
    return whole.select(
        "file",
        "depth",
        _node(d, sa, sb).alias("node"),
        _node(d - 1, *before).alias("parent"),
        "chars",
        (F.col("last") & ~F.coalesce("_more", F.lit(False))).alias("ends"),
    )


def _with_band(steps: DataFrame, stride: int, height: int) -> DataFrame:
    """Adds ``above``: ids of the node and its ancestors in its band, of every ``stride``-th depth.

    A recording has at most ``height`` rows in a band, so bands are bounded groups. The root belongs to the first.
    Where depths are left out, ``parent`` of a band's top becomes the node one stride above it.
    """
    band = F.floor(F.col("depth") / (stride * height))
    rows = steps.where(F.col("depth") % stride == 0) if stride > 1 else steps
    inside = Window.partitionBy("file", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    above = F.collect_list("node").over(inside)
    if stride > 1:
        upto = Window.partitionBy("file", F.floor((F.col("depth") - 1) / (stride * height))).orderBy("depth")
        rows = rows.withColumn("parent", F.lag("node").over(upto))
    rows = rows.withColumn("band", band).withColumn("above", above)
    root = F.when(F.col("band") == 0, F.array(_root())).otherwise(F.array().cast("array<binary>"))
    return rows.withColumn("above", F.concat(root, "above")).drop("band")


def _in_band(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sums of ``values`` over each node's subtree inside its band."""
    return (
        nodes.select(F.explode("above").alias("node"), *values)
        .groupBy("node")
        .agg(*[F.sum(v).alias(v) for v in values])
    )


def _rolled(nodes: DataFrame, steps: DataFrame, values: Sequence[str], stride: int, height: int, deepest: int) -> DataFrame:
    """(node, *values*): sums over whole subtrees of the nodes of every ``stride``-th depth.

    First each node adds to its ancestors in its band. The tops of the bands then make a tree that is ``height`` times
    flatter, whose subtree sums are found in the same way, and each band's top adds its whole sum to its parent and the
    parent's ancestors in the parent's band. A tree of depth D takes log(D) rounds to the base ``height``.
    """
    sums = _in_band(nodes, values)
    if deepest < stride * height:
        return sums
    sums = durable(sums)
    wide = stride * height
    tops = _with_band(steps, wide, height).groupBy("node")
    tops = tops.agg(*[F.first(c).alias(c) for c in ("parent", "above", "depth")])
    root = nodes.where("depth = 0").select("node", "parent", "above", "depth")
    tops = tops.unionByName(root).join(sums, "node")
    whole = durable(_rolled(tops, steps, values, wide, height, deepest))
    # A top's place in the band above: the ancestors of its parent among the nodes of this stride.
    hangs = nodes.where((F.col("depth") % wide == 0) & (F.col("depth") > 0)).select("node", "parent")
    given = hangs.join(whole, "node").drop("node")
    band_of_parent = nodes.select(F.col("node").alias("parent"), "above")
    passed = _in_band(given.join(band_of_parent, "parent"), values)
    return sums.unionByName(passed).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def call_trie(
    det: DataFrame,
    recordings: DataFrame | None = None,
    file: str = "file",
    at: str = "start_s",
    name: str = "scientific_name",
    label: str = "common_name",
    height: int = BAND_HEIGHT,
) -> Trie:
    """Which recordings begin with the same calls, and how much text they share.

    A recording is the sequence of its detections by ``at`` (null first; calls of one time in a fixed order that is the
    same for all recordings); ``recordings`` may list further ones without any. Each distinct sequence of first d calls (name, label) is a node of
    depth d, below the root of all recordings (d = 0). ``nodes`` has one row per node: ``node`` (id), ``depth``, ``file``
    (its smallest recording), ``parent_file`` (that of its parent; null for the root), ``n_recordings``, ``n_children``, and over
    its subtree, itself included, ``n_leaves`` (nodes without children) and ``saved_chars`` (recordings but one, times
    characters of the last label): what writing every shared beginning once would save. ``ends`` has (file, node) of every recording.

    Null names and labels count as empty; rows with a null key take no part; equal rows count each; further
    columns are ignored; without any recording there is no node. Texts of any length count whole.

    No recording and no node is one task's work: calls are numbered and hashed in range partitions with carried
    sums, members of a node are combined before the shuffle, and a node adds to at most ``height`` ancestors a round.
    """
    empty = F.lit("")
    calls = det.where(F.col(file).isNotNull()).select(
        F.col(file).alias("file"),
        F.col(at).alias("at"),
        F.coalesce(F.col(name).cast("string"), empty).alias("name"),
        F.coalesce(F.col(label).cast("string"), empty).alias("label"),
    )
    steps = durable(_steps(calls))
    listed = steps.where("depth = 1").select("file")
    silent = None
    if recordings is not None:
        every = recordings.where(F.col(file).isNotNull()).select(F.col(file).alias("file")).distinct()
        silent = every.join(listed, "file", "left_anti")
        listed = listed.unionByName(silent)
    top = listed.agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n_recordings")).where("n_recordings > 0")
    found = (
        _with_band(steps, 1, height)
        .groupBy("node")
        .agg(
            F.first("parent").alias("parent"),
            F.first("depth").alias("depth"),
            F.first("above").alias("above"),
            F.min("file").alias("file"),
            F.count(F.lit(1)).alias("n_recordings"),
            F.count_if("ends").alias("n_ends"),
            F.first("chars").alias("chars"),
        )
    )
    own = found.select(
        "node",
        "parent",
        "depth",
        "above",
        "file",
        "n_recordings",
        # Where all members end there is no child.
        (F.col("n_ends") == F.col("n_recordings")).cast("long").alias("n_leaves"),
        ((F.col("n_recordings") - 1) * F.col("chars")).alias("saved_chars"),
    )
    deepest = steps.agg(F.max("depth")).first()[0] or 0
    root = top.select(
        _root().alias("node"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("depth"),
        F.array(_root()).alias("above"),
        "file",
        "n_recordings",
        F.lit(int(deepest == 0)).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_chars"),
    )
    nodes = durable(own.unionByName(root))
    values = ["n_leaves", "saved_chars"]
    totals = _rolled(nodes, steps, values, 1, height, deepest)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = nodes.drop(*values, "above").join(totals, "node").join(children, "node", "left")
    parents = nodes.select(F.col("node").alias("parent"), F.col("file").alias("parent_file"))
    # The root is the parent of a large share of all nodes; it is one row.
    at_top = parents.where(F.col("parent") == _root()).select("parent_file")
    first = whole.where("depth = 1").select("*", at_top.scalar().alias("parent_file"))
    top_row = whole.where("depth = 0").withColumn("parent_file", F.lit(None).cast(nodes.schema["file"].dataType))
    deeper = whole.where("depth > 1").join(parents, "parent", "left")
    columns = ["node", "depth", "file", "parent_file", "n_recordings", "n_children", "n_leaves", "saved_chars"]
    rows = first.select(whole.columns + ["parent_file"]).unionByName(top_row).unionByName(deeper)
    ends = steps.where("ends").select("file", "node")
    if silent is not None:
        ends = ends.unionByName(silent.select("file", _root().alias("node")))
    return Trie(rows.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).select(*columns), ends)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, digest): SHA-256 of the keys of the recordings that end at each node, ascending, joined by commas.

    Keys are joined in range partitions of (node, key); a node with very many is a few long rows where its digest
    is taken, one behind the other.
    """
    key = F.col("file")
    rows = ends.select("node", "file", key.cast("string").alias("text"))
    spread = rows.repartitionByRange("node", "file").sortWithinPartitions("node", "file")
    kind = ends.schema["file"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = first = None
        held: list[str] = []
        size = 0
        schema = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([first], schema.field(1).type), pa.array([",".join(held)])],
                names=["node", "file", "keys"],
            )

        for batch in batches:
            schema = batch.schema
            for at, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (at != node or size > CHUNK_CHARS):
                    yield row()
                    held, size = [], 0
                if not held:
                    node, first = at, key
                held.append(text)
                size += len(text) + 1
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for at, keys in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at == node:
                    state.update(b",")
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(keys.encode())
            yield _digests(done)
        if state:
            yield _digests([(node, state.hexdigest())])

    chunks = mapped(spread, join, f"node binary, file {kind}, keys string")
    dealt = chunks.repartition("node").sortWithinPartitions("node", "file")
    return mapped(dealt, digest, "node binary, digest string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    nodes, digests = [r[0] for r in rows], [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "digest"])
