"""Repeated passages of result files, found by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.shared import durable, mapped
from dawnchorus.scale import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, fits_broadcast

# A removed passage has at least so many words.
MIN_WORDS = 30
# Shorter chunks are no evidence; longer passages hold several chunks.
MIN_CHUNK_BYTES = 24
# A chunk ends at the lowest rolling hash among so many lines on either side.
NEIGHBOURS = 4
# Bytes compared beyond a chunk on either side. Chunks lie far denser than this.
REACH = 192
# Bytes hashed at once; a longer text is chunked part by part.
PART = 1 << 20
LINE_END, SPACE = 10, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _hash_tables() -> list[np.ndarray]:
    """A random value per byte, and the powers of an odd number and of its inverse."""
    if not _tables:
        signs = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64)
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        powers = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(PART + 1, f)]) for f in (_ODD, inverse)]
        _tables.extend([signs, *powers])
    return _tables


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _group_chunks(parts: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """(row, key, start, end) of the chunks of some parts (row, offset, bytes), which lie end to end."""
    signs, powers, inverse = _hash_tables()
    sizes = np.array([len(p) + 1 for _, _, p in parts])
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    data = np.frombuffer(b"\n".join([p for _, _, p in parts]) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero((data == SPACE) | (data == LINE_END))
    starts = np.r_[0, ends[:-1] + 1]
    owner = np.searchsorted(begins, starts, side="right") - 1
    sums = np.r_[np.uint64(0), np.cumsum(signs[data] * powers[: len(data)], dtype=np.uint64)]
    lines = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    last = np.r_[owner[1:] != owner[:-1], True]
    before = np.where(np.r_[True, last[:-1]], np.uint64(0), np.r_[np.uint64(0), lines[:-1]])
    rolling = _mixed(lines * _ODD + before)
    lowest = np.ones(len(rolling), dtype=bool)
    for d in range(1, min(NEIGHBOURS, len(rolling) - 1) + 1):
        apart = owner[d:] != owner[:-d]
        lowest[d:] &= (rolling[d:] < rolling[:-d]) | apart
        lowest[:-d] &= (rolling[:-d] < rolling[d:]) | apart
    cut = np.flatnonzero(lowest | last)
    first = np.r_[0, cut[:-1] + 1]
    start, end = starts[first], ends[cut]
    keys = _mixed((sums[end] - sums[start]) * inverse[start])
    several = (cut > first) & (end - start >= MIN_CHUNK_BYTES)
    of = owner[first][several]
    shift = np.array([o for _, o, _ in parts])[of] - begins[of]
    rows = np.array([r for r, _, _ in parts])[of]
    return [rows, keys[several].view(np.int64), start[several] + shift, end[several] + shift]


def chunks(texts: list[str]) -> list[np.ndarray]:
    """(row, key, start, end) of the multi-line chunks of texts, in UTF-8 bytes.

    Written lines of prose may be whole paragraphs, so lines are wrapped after every word. A rolling hash over
    a line's hash and the one before it decides where chunks end: wherever it is lowest among its
    neighbours. A chunk's ends thus depend on the lines around them alone, wherever they stand, and
    any fifty words hold at least one whole chunk, but for a chance of about 1 in 10 000.
    """
    found, parts, size = [], [], 0
    for row, text in enumerate(texts):
        data = text.encode("utf-8")
        for at in range(0, len(data), PART):
            part = data[at : at + PART]
            if parts and size + len(part) + 1 > PART:
                found.append(_group_chunks(parts))
                parts, size = [], 0
            parts.append((row, at, part))
            size += len(part) + 1
    if parts:
        found.append(_group_chunks(parts))
    if not found:
        return [np.zeros(0, dtype=np.int64)] * 4
    return [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)]


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == SPACE) | ((data >= 9) & (data <= 13))


def equal_spans(
    own: bytes, other: bytes, words: int, left: tuple[bool, bool], right: tuple[bool, bool]
) -> list[tuple[int, int]]:
    """Word-aligned spans of ``own`` that equal ``other`` byte by byte at the same place.

    ``left`` and ``right`` say of ``own`` and ``other`` whether a word begins, or ends, with the bytes given. A
    span takes the white space behind it along; it holds at least ``words`` words.
    """
    a, b = np.frombuffer(own, dtype=np.uint8), np.frombuffer(other, dtype=np.uint8)
    n = min(len(a), len(b))
    same = np.r_[False, a[:n] == b[:n], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    # Where a word may begin, and where it is over, in each text.
    begins = [np.r_[edge, _blank(x)[:-1]] if len(x) else np.zeros(0, dtype=bool) for x, edge in zip((a, b), left, strict=True)]
    over = [np.r_[_blank(x), edge] for x, edge in zip((a, b), right, strict=True)]
    gap = _blank(a)
    spans = []
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if not (begins[0][start] and begins[1][start]):
            gaps = np.flatnonzero(gap[start:end])
            if not len(gaps):
                continue
            start += int(gaps[0]) + 1
        if over[0][end] and over[1][end]:
            end = min(end + 1, len(a))
        else:
            gaps = np.flatnonzero(gap[start:end])
            if not len(gaps):
                continue
            end = start + int(gaps[-1]) + 1
        if end > start and len(own[start:end].split()) >= words:
            spans.append((start, end))
    return spans


def _chunk_rows(files: DataFrame) -> DataFrame:
    """(file, version, key, start, end) of every chunk."""
    kind = files.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, *places = chunks(batch.column(2).to_pylist())
            at = pa.array(rows)
            columns = [batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, places)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "version", "key", "start", "end"])

    schema = f"file {kind}, version int, key long, start long, end long"
    return mapped(files, run, schema)


def _compared(pairs: DataFrame, min_words: int) -> DataFrame:
    """(file, version, start, end) of the spans that are equal."""
    kind = pairs.schema["file"].dataType.simpleString()
    columns = ["file", "version", "at", "size", "own", "other", "first_at", "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            places = zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True)
            for i, (at, size, own, other, first_at, long) in enumerate(places):
                # The other text comes with the byte before the window.
                before, other = (other[:1], other[1:]) if first_at else (b" ", other)
                left = at == 0, not before.strip()
                right = at + len(own) >= size, len(other) < long
                for s, e in equal_spans(own, other, min_words, left, right):
                    rows.append(i)
                    starts.append(at + s)
                    ends.append(at + e)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                ],
                names=["file", "version", "start", "end"],
            )

    schema = f"file {kind}, version int, start long, end long"
    return mapped(pairs.select(*columns), run, schema)


def _pieces(spans: DataFrame) -> DataFrame:
    """Merged spans of each text, and the pieces between them."""
    kind = spans.schema["file"].dataType.simpleString()
    listed = spans.groupBy("file", "version").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for found in batch.column(2).to_pylist():
                merged: list[list[int]] = []
                for s in found:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                removed.append([{"start": s, "end": e} for s, e in merged])
                ends = [0, *(e for _, e in merged)]
                kept.append(
                    [{"start": a, "end": b} for a, b in zip(ends, [s for s, _ in merged] + [2**31 - 1], strict=True)]
                )
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, span), pa.array(kept, span)],
                names=["of", "of_version", "removed", "kept"],
            )

    span = "array<struct<start: long, end: long>>"
    return mapped(listed, run, f"of {kind}, of_version int, removed {span}, kept {span}")


def _bounded(side: DataFrame) -> bool:
    """Whether durable rows are few enough to broadcast, by measure."""
    return fits_broadcast(side, BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES)


def remove_repeated_lines(
    results: DataFrame, file: str = "file", content: str = "content", min_words: int = MIN_WORDS
) -> DataFrame:
    """Remove passages of several lines that an earlier result file holds already.

    ``results`` has one row per result file: its key ``file`` and its whole text ``content``. Chunks
    whose hash occurs in more than one file point to the file with the smallest key. Neighbouring chunks that
    point to the same place are one passage; its bytes, and those around it, are compared with the
    first file's, and what is equal, from word to word, is cut if it has ``min_words`` words. What a
    file loses thus always stays in a file with a smaller key. Whole copies become (nearly) empty.

    Returns every input row with all its columns, ``content`` cut, and ``removed``: the spans cut, in
    UTF-8 bytes of the original (empty if none). A null text or key leaves a row as it is; rows
    with the same key are one file and never cut each other; an empty table gives an empty table.

    Chunks travel as numbers and are combined before their shuffle; where one chunk occurs in very many
    files, its join partition can be split. Texts that share nothing are not shuffled, as long as
    the keys of the others, and their spans, are few enough to broadcast (measured); beyond that every
    text is shuffled for the comparison and once more for the cut.
    """
    own = results.select(
        F.col(file).alias("file"), F.hash(content).alias("version"), F.col(content).alias("content")
    )
    files = own.where("file IS NOT NULL AND content IS NOT NULL")
    found = _chunk_rows(files)
    repeated = durable(
        found.groupBy("key")
        .agg(F.min("file").alias("first"), F.max("file").alias("last"))
        .where("first <> last")
        .select("key", "first")
    )
    marks = durable(found.join(repeated, "key"))
    firsts = durable(
        marks.where("file = first")
        .groupBy("key")
        .agg(F.min(F.struct("start", "version")).alias("p"))
        .select("key", F.col("p.start").alias("first_start"), F.col("p.version").alias("first_version"))
    )
    place = ["file", "version", "first", "first_version"]
    runs = (
        marks.where("file <> first")
        .join(firsts, "key")
        .groupBy(*place, (F.col("first_start") - F.col("start")).alias("shift"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("at", F.col("start") - F.least(F.lit(REACH), "start", F.col("start") + F.col("shift")))
        .withColumn("long", F.col("end") + REACH - F.col("at"))
        .withColumn("first_at", F.col("at") + F.col("shift"))
        .select(*place, "at", "long", "first_at")
    )
    runs = durable(runs)
    # Of all texts only those are shuffled that have a part in a run, while their keys fit a broadcast.
    involved = runs.select("file", "version").unionAll(runs.select("first", "first_version")).distinct()
    involved = durable(involved.select(F.col("file").alias("f"), F.col("version").alias("v")))
    texts = files.select(F.col("file").alias("f"), F.col("version").alias("v"), F.col("content").cast("binary").alias("bytes"))
    if _bounded(involved):
        texts = texts.join(F.broadcast(involved), ["f", "v"], "left_semi")

    def window(start: str) -> Column:
        return F.expr(f"substring(bytes, cast({start} + 1 as int), cast(long as int))")

    before = F.expr(
        "if(aa > 0, substring(bytes, cast(aa as int), cast(long + 1 as int)), substring(bytes, 1, cast(long as int)))"
    )
    # Repeated rows of a text give the same windows; one of them is enough.
    mine = (
        runs.hint("shuffle_hash")
        .join(texts, (F.col("file") == F.col("f")) & (F.col("version") == F.col("v")))
        .select(*place, "at", "long", "first_at", window("at").alias("own"), F.octet_length("bytes").cast("long").alias("size"))
        .groupBy(*place, "at", "long", "first_at")
        .agg(F.first("own").alias("own"), F.first("size").alias("size"))
    )
    asked = runs.select(
        F.col("first").alias("af"), F.col("first_version").alias("av"), F.col("first_at").alias("aa"), "long"
    ).distinct()
    theirs = (
        asked.hint("shuffle_hash")
        .join(texts, (F.col("af") == F.col("f")) & (F.col("av") == F.col("v")))
        .select("af", "av", "aa", F.col("long").alias("al"), before.alias("other"))
        .groupBy("af", "av", "aa", "al")
        .agg(F.first("other").alias("other"))
    )
    pairs = mine.join(
        theirs,
        (F.col("first") == F.col("af"))
        & (F.col("first_version") == F.col("av"))
        & (F.col("first_at") == F.col("aa"))
        & (F.col("long") == F.col("al")),
    )
    pieces = durable(_pieces(_compared(pairs, min_words)))
    rows = results.select(
        F.struct("*").alias("row"),
        F.col(file).alias("file"),
        F.hash(content).alias("version"),
        F.col(content).cast("binary").alias("bytes"),
    )
    joined = rows.join(
        F.broadcast(pieces) if _bounded(pieces) else pieces,
        (F.col("file") == F.col("of")) & (F.col("version") == F.col("of_version")),
        "left",
    )
    piece = "cast(substring(bytes, cast(p.start + 1 as int), cast(p.end - p.start as int)) as string)"
    cut = F.expr(f"array_join(transform(kept, p -> {piece}), '')")
    text = F.col("row").getField(content)
    columns = [F.col("row").getField(c).alias(c) for c in results.columns if c not in (content, "removed")]
    nothing = F.array().cast("array<struct<start: long, end: long>>")
    return joined.select(
        *columns,
        F.when(F.col("kept").isNull(), text).otherwise(cut).alias(content),
        F.coalesce("removed", nothing).alias("removed"),
    )
