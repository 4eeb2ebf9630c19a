"""Stretches of a recording's label track that repeat one phrase over and over, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.labels import species_label
from dawnchorus.llm.shared import mapped

# A run has this many labels at least, and this many times its period.
MIN_LENGTH, MIN_REPEATS = 24, 3
# Positions whose extension is asked for together.
QUERIES_AT_ONCE = 1 << 18
# Labels of tracks that are compressed together; a longer track is alone.
LABELS_AT_ONCE = 1 << 16
# The symbol between tracks; it takes part in no rule.
BORDER = 0


@dataclass
class Level:
    """One level of the grammar: its symbols and how the next level groups them.

    Symbol ``k`` lies in symbol ``up[k]`` of the next level, which begins with symbol ``first[up[k]]``;
    ``blocks``: the groups are repetitions of one symbol, otherwise they are pairs.
    """

    symbols: np.ndarray
    first: np.ndarray
    up: np.ndarray
    blocks: bool


class Grammar:
    """Run-length grammar of label tracks, each between two borders.

    Blocks of one symbol and pairs of unlike symbols are replaced in turn until every track is one symbol. A pair is
    replaced where its first symbol is of one random half of all symbols and its second of the other, so
    whether neighbours join depends on these two alone, and equal stretches get equal symbols but at their ends.
    """

    def __init__(self, symbols: np.ndarray, tracks: int, seed: int = 1):
        self.levels: list[Level] = []
        fresh = int(symbols.max(initial=0)) + 1
        rng = np.random.default_rng(seed)
        while len(symbols) > 2 * tracks + 1:
            same = (symbols[1:] == symbols[:-1]) & (symbols[1:] != BORDER)
            if same.any():
                symbols, fresh = self._blocks(symbols, same, fresh)
            else:
                symbols, fresh = self._pairs(symbols, fresh, rng)
        self.top = symbols

    def _replace(self, symbols: np.ndarray, opens: np.ndarray, blocks: bool) -> tuple[np.ndarray, Level]:
        start = np.flatnonzero(opens).astype(np.int32)
        up = np.cumsum(opens, dtype=np.int32) - np.int32(1)
        level = Level(symbols, np.append(start, np.int32(len(symbols))), up, blocks)
        self.levels.append(level)
        return symbols[start], level

    def _blocks(self, symbols: np.ndarray, same: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        made, level = self._replace(symbols, np.append(True, ~same), True)
        times = np.diff(level.first)
        long = np.flatnonzero(times > 1)
        rules = made[long].astype(np.int64) << 32 | times[long]
        return self._named(made, long, rules, fresh)

    def _pairs(self, symbols: np.ndarray, fresh: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
        while True:
            factor, shift = int(rng.integers(1 << 62)) | 1, int(rng.integers(20, 40))
            side = (symbols.astype(np.uint64) * np.uint64(factor) >> np.uint64(shift)) & np.uint64(1)
            inside = symbols != BORDER
            left, right = inside & (side == 0), inside & (side == 1)
            one, other = left[:-1] & right[1:], right[:-1] & left[1:]
            joins = one if np.count_nonzero(one) >= np.count_nonzero(other) else other
            if joins.any():
                break
        heads = np.flatnonzero(joins)
        rules = symbols[heads].astype(np.int64) << 32 | symbols[heads + 1]
        made, level = self._replace(symbols, np.append(True, ~joins), False)
        return self._named(made, level.up[heads], rules, fresh)

    @staticmethod
    def _named(made: np.ndarray, at: np.ndarray, rules: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        names, which = np.unique(rules, return_inverse=True)
        made[at] = which + fresh
        return made, fresh + len(names)

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` on are equal one by one, to the right or to the left.

        ``i`` < ``j`` lie in one track or on its borders. Every query climbs as long as both positions can be moved to
        the edge of a symbol of the next level over equal symbols, then comes down to the first difference, one
        step a level.
        """
        way = 1 if forward else -1
        ask, a, b = np.arange(len(i)), i.astype(np.int32), j.astype(np.int32)
        stopped = []
        for level in self.levels:
            up_a, up_b = level.up[a], level.up[b]
            differ = level.symbols[a] != level.symbols[b]
            if forward:
                inner = (level.first[up_a] != a) | (level.first[up_b] != b)
            else:
                inner = (level.first[up_a + 1] - 1 != a) | (level.first[up_b + 1] - 1 != b)
            step = inner & ~differ
            uneven = np.zeros(len(a), bool)
            by = np.ones(len(a), np.int32)
            if level.blocks:
                left_a, left_b = self._left(level, a, forward), self._left(level, b, forward)
                by, uneven = np.minimum(left_a, left_b), step & (left_a != left_b)
            by = np.where(step, by, 0) * way
            a, b = a + by, b + by
            halt = differ | uneven
            stopped.append((ask[halt], a[halt], b[halt]))
            on = ~halt
            ask, a, b = ask[on], a[on], b[on]
            a, b = level.up[a], level.up[b]
        for level, (halted, at_a, at_b) in zip(reversed(self.levels), reversed(stopped), strict=True):
            if len(ask):
                if forward:
                    a, b = level.first[a], level.first[b]
                else:
                    a, b = level.first[a + 1] - 1, level.first[b + 1] - 1
                by = (level.symbols[a] == level.symbols[b]).astype(np.int32)
                if level.blocks:
                    by *= np.minimum(self._left(level, a, forward), self._left(level, b, forward))
                a, b = a + by * way, b + by * way
            ask, a, b = np.append(ask, halted), np.append(a, at_a), np.append(b, at_b)
        found = np.empty(len(i), np.int64)
        found[ask] = (a - i[ask]) * way
        return found

    @staticmethod
    def _left(level: Level, at: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols of the block from a position to the block's end in this direction."""
        group = level.up[at]
        return level.first[group + 1] - at if forward else at - level.first[group] + 1


def _grids(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(track, period, offset) of the candidates, in portions.

    A run of period p holds, for max(24, 3 p) - p positions in a row, equal labels p apart, so of a grid that wide one
    point lies in every run. Over all periods the grids shrink like the harmonic series.
    """
    periods = np.where(sizes >= MIN_LENGTH, sizes // MIN_REPEATS, 0)
    ends = np.cumsum(periods)
    per_portion = max(1, QUERIES_AT_ONCE // 2)
    for low in range(0, int(ends[-1]) if len(ends) else 0, per_portion):
        pair = np.arange(low, min(low + per_portion, int(ends[-1])))
        track = np.searchsorted(ends, pair, "right")
        period = pair - (ends - periods)[track] + 1
        width = np.maximum(MIN_LENGTH, MIN_REPEATS * period) - period
        points = (sizes[track] - period - 1) // width + 1
        upto = np.cumsum(points)
        cuts = np.searchsorted(upto, np.arange(QUERIES_AT_ONCE, int(upto[-1]) + QUERIES_AT_ONCE, QUERIES_AT_ONCE))
        begin = 0
        for end in np.minimum(cuts + 1, len(pair)):
            if end <= begin:
                continue
            some = slice(begin, int(end))
            times = points[some]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(track[some], times), np.repeat(period[some], times), place * np.repeat(width[some], times)
            begin = int(end)


def find_runs(labels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, as positions in the labels of all tracks one behind the other.

    ``labels`` are numbers; tracks have ``sizes`` labels each. Runs are ordered by start, then period.
    """
    none = np.empty(0, np.int64)
    sizes = sizes.astype(np.int64)
    long = sizes >= MIN_LENGTH
    if not long.any():
        return none, none, none
    whole = np.cumsum(sizes) - sizes
    kept, origin = sizes[long], whole[long]
    # Tracks of one symbol or more, a border before, between and behind them.
    begin = np.cumsum(kept + 1) - kept
    symbols = np.full(int(kept.sum()) + len(kept) + 1, BORDER, np.int32)
    place = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
    symbols[place + np.repeat(begin, kept)] = labels[place + np.repeat(origin, kept)] + 1
    grammar = Grammar(symbols, len(kept))
    found = []
    for track, period, offset in _grids(kept):
        i = begin[track] + offset
        hit = symbols[i] == symbols[i + period]
        track, period, i = track[hit], period[hit], i[hit]
        ahead = grammar.extension(i, i + period, True)
        back = grammar.extension(i - 1, i + period - 1, False)
        enough = ahead + back + period >= np.maximum(MIN_LENGTH, MIN_REPEATS * period)
        track, period, i = track[enough], period[enough], i[enough]
        start, end = i - back[enough], i + period + ahead[enough]
        moved = (origin - begin)[track]
        run = np.stack([start + moved, end + moved, period])
        # Neighbouring grid points of one period mostly lie in the same run.
        found.append(run[:, np.append(True, (run[:, 1:] != run[:, :-1]).any(axis=0))[: run.shape[1]]])
    if not found:
        return none, none, none
    start, end, period = np.concatenate(found, axis=1)
    # A stretch that repeats p labels also repeats 2 p, 3 p, …: the smallest period names it.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(label numbers, sizes, labels) of a column of label lists; absent lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.flatten(), "")
    codes = pc.dictionary_encode(values).indices.to_numpy(zero_copy_only=False)
    return codes, sizes.astype(np.int64), values


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about LABELS_AT_ONCE labels, so that memory does not follow the size of an Arrow batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            upto = (int(ends[low - 1]) if low else 0) + LABELS_AT_ONCE
            high = max(low + 1, int(np.searchsorted(ends, upto, "right")))
            yield batch.slice(low, high - low)
            low = high


def label_tracks(det: DataFrame) -> DataFrame:
    """(file, labels): the species labels of every recording's detections in detection order.

    A recording's track is one row. Detections without a file make a track of their own with a null ``file``; absent
    names are empty; equal detections count each; further columns are ignored.
    """
    label = F.coalesce(species_label(F.coalesce("scientific_name", F.lit("")), F.coalesce("common_name", F.lit(""))), F.lit(""))
    place = F.struct("start_s", (-F.col("confidence")).alias("c"), "scientific_name", "common_name", "end_s", label.alias("label"))
    ordered = F.array_sort(F.collect_list(place))
    return det.groupBy("file").agg(F.transform(ordered, lambda r: r["label"]).alias("labels"))


def repeated_phrases(tracks: DataFrame, file: str = "file", labels: str = "labels") -> DataFrame:
    """Where a recording's labels repeat one phrase, such as a song sung over and over.

    ``tracks`` has one row per recording: its key and its labels in order (``label_tracks`` makes it from detections).
    A run is a stretch of consecutive labels with smallest period p (labels p apart are equal) of max(24, 3 p)
    labels or more that neither neighbour continues with that period. Returns one row per input row:
    ``file``, ``n_labels``, ``runs`` (array of ``start``, ``length``, ``period``; by start, then period) and
    ``collapsed``: the labels without those that a run holds after its first period.

    Runs are exact. Tracks of some labels in all (LABELS_AT_ONCE) are compressed together into a run-length grammar, and extensions of grid
    candidates are asked from it, so a track of n labels takes about n log n steps. Rows need no shuffle; one
    track is one task's work and takes about 100 bytes of memory a label.

    Null labels count as empty text, null or empty lists have no runs; a null key stays null; repeated rows
    count each; further columns are ignored.
    """
    kind = tracks.schema[file].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pa.int64()
        for batch in _portions(batches):
            codes, sizes, values = _flat(batch.column(1))
            start, end, period = find_runs(codes, sizes)
            begin = np.append(0, np.cumsum(sizes))
            track = np.searchsorted(begin, start, "right") - 1
            fields = [start - begin[track], end - start, period]
            runs = pa.StructArray.from_arrays([pa.array(v, number) for v in fields], ["start", "length", "period"])
            per_track = np.append(0, np.cumsum(np.bincount(track, minlength=len(sizes))))
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, end, -1)
            stays = np.cumsum(edge[:-1]) == 0
            stay_ends = np.append(0, np.cumsum(stays))[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, number),
                    pa.ListArray.from_arrays(pa.array(per_track, pa.int32()), runs),
                    pa.ListArray.from_arrays(pa.array(stay_ends, pa.int32()), values.filter(pa.array(stays))),
                ],
                names=[file, "n_labels", "runs", "collapsed"],
            )

    schema = (
        f"`{file}` {kind}, n_labels long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed array<string>"
    )
    return mapped(tracks.select(file, labels), run, schema)
