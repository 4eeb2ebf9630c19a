"""Test items inside training texts: BM25 with block-max WAND, then question and answer overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.shared import durable, mapped

K1, B = 1.2, 0.75
# Share of an item's own score that a passage must reach.
THRESHOLD = 0.6
SHINGLE_WORDS = 5
OVERLAP = 0.8
# Postings per block of a term's list.
BLOCK = 8
# Share of an item's score that the first look leaves to its most common terms.
LEFT_OUT = 0.35
# Items of one index; more items make more indexes, used one after another.
ITEMS_PER_INDEX = 4096
# Cells of passages times items held at once.
CELLS = 1 << 21
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def contained(part: list[str], whole: list[str]) -> float:
    """Share of the five-word shingles of ``part`` that ``whole`` has; a shorter part is one shingle."""
    n = min(SHINGLE_WORDS, len(part))
    if not n:
        return 1.0
    has = {tuple(whole[i : i + n]) for i in range(len(whole) - n + 1)}
    asked = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    return len(asked & has) / len(asked)


class Statistics(NamedTuple):
    """What BM25 knows of all items that have words; ``frequency`` is asked for an index's own terms only."""

    items: int
    mean: float
    longest: int
    frequency: dict[str, int]


class ItemIndex:
    """Inverted index of test items whose impacts are shares of the item's own BM25 score.

    ``whole`` describes all items where the index holds a part of them.
    """

    def __init__(self, items: list[tuple[object, str | None, str | None]], whole: Statistics | None = None):
        kept = [(i, words_of(q), words_of(a)) for i, q, a in items]
        self.items = [x for x in kept if x[1] or x[2]]
        bags = [Counter(q + a) for _, q, a in self.items]
        lengths = [sum(b.values()) for b in bags]
        whole = whole or Statistics(
            len(bags),
            sum(lengths) / max(1, len(lengths)),
            max(lengths, default=1),
            Counter(t for b in bags for t in b),
        )
        self.longest, mean, frequency = whole.longest, whole.mean, whole.frequency
        postings: dict[str, list[tuple[int, float]]] = {}
        self.terms = {t: k for k, t in enumerate(sorted({t for b in bags for t in b}))}
        spare = np.zeros(len(bags))
        look: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for number, (bag, length) in enumerate(zip(bags, lengths, strict=True)):
            score = {}
            for t, tf in bag.items():
                idf = np.log(1 + (whole.items - frequency[t] + 0.5) / (frequency[t] + 0.5))
                score[t] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))
            own = sum(score.values())
            for t in sorted(score, key=lambda t: (-frequency[t], t)):
                share = score[t] / own
                postings.setdefault(t, []).append((number, share))
                if spare[number] + share <= LEFT_OUT:
                    spare[number] += share
                else:
                    look[self.terms[t]].append((number, share))
        # By term: item numbers, impacts, and of each block the last item and the largest impact.
        self.lists = {}
        for t, found in postings.items():
            found.sort()
            numbers, impacts = [n for n, _ in found], [s for _, s in found]
            blocks = range(0, len(found), BLOCK)
            self.lists[t] = (
                numbers,
                impacts,
                [numbers[min(b + BLOCK, len(found)) - 1] for b in blocks],
                [max(impacts[b : b + BLOCK]) for b in blocks],
                max(impacts),
            )
        # The first look: of each term the items for which it is not among the most common terms.
        self.sizes = np.array([len(x) for x in look] + [0], dtype=np.int64)
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.look_items = np.array([n for x in look for n, _ in x], dtype=np.int64)
        self.look_shares = np.array([s for x in look for _, s in x])
        self.spare = spare

    def hopeful(self, ids: np.ndarray, passage: np.ndarray, passages: int, threshold: float) -> np.ndarray:
        """Passages for which some item may reach the threshold.

        ``ids`` are the terms met and ``passage`` where. The sum over the looked-at terms, repeats
        included, plus all that an item's left-out terms could add, is an upper bound of its score.
        """
        sizes = self.sizes[ids]
        held = sizes > 0
        ids, passage, sizes = ids[held], passage[held], sizes[held]
        at = np.repeat(self.offsets[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        cell = np.repeat(passage, sizes) * len(self.items) + self.look_items[at]
        bound = np.bincount(cell, self.look_shares[at], passages * len(self.items))
        may = bound.reshape(passages, -1) + self.spare >= threshold - 1e-9
        return np.flatnonzero(may.any(axis=1))

    def retrieve(self, terms: set[str], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the terms reaches the threshold, by block-max WAND."""
        cursors = [[0, self.lists[t]] for t in sorted(terms) if t in self.lists]
        found = []
        threshold -= 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[1][0][c[0]])
            total, pivot = 0.0, -1
            for k, (_, entry) in enumerate(cursors):
                total += entry[4]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == item:
                pivot += 1
            bound, after = 0.0, None
            for at, entry in cursors[: pivot + 1]:
                block = max(at // BLOCK, bisect_left(entry[2], item))
                if block < len(entry[2]):
                    bound += entry[3][block]
                    after = min(after, entry[2][block]) if after is not None else entry[2][block]
            if bound < threshold:
                # No item up to the end of the nearest block can reach it.
                target = max(item, after if after is not None else item) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, max(item + 1, cursors[pivot + 1][1][0][cursors[pivot + 1][0]]))
            else:
                if cursors[0][1][0][cursors[0][0]] == item:
                    score = sum(e[1][a] for a, e in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            for cursor in cursors[: pivot + 1]:
                cursor[0] = bisect_left(cursor[1][0], target, cursor[0])
            cursors = [c for c in cursors if c[0] < len(c[1][0])]
        return found

    def matches(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[tuple]]:
        """Of each text its verified (item, score, question overlap, answer overlap)."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        stride, none = self.longest, len(self.terms)
        most = max(1, CELLS // len(self.items))
        queue: list[tuple[int, int, list[str]]] = []

        def look() -> None:
            if not queue:
                return
            ids = [np.fromiter(map(self.terms.get, w, [none] * len(w)), np.int64, len(w)) for _, _, w in queue]
            owner = np.repeat(np.arange(len(queue)), [len(i) for i in ids])
            for k in self.hopeful(np.concatenate(ids), owner, len(queue), threshold).tolist():
                text, _, passage = queue[k]
                for item, score in self.retrieve(set(passage), threshold):
                    _, question, answer = self.items[item]
                    q, a = contained(question, passage), contained(answer, passage)
                    if q >= overlap and a >= overlap and (score, q, a) > out[text].get(item, (0,)):
                        out[text][item] = (score, q, a)
            queue.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            # Passages of twice the longest item, half overlapping: every item lies whole in one.
            for at in range(0, max(1, len(words) - stride), stride):
                queue.append((i, at, words[at : at + 2 * stride]))
                if len(queue) >= most:
                    look()
        look()
        return [[(self.items[n][0], *m) for n, m in sorted(found.items())] for found in out]


def _bags(items: DataFrame, parts: int) -> DataFrame:
    """(part, length, terms) of every item with words; ``terms`` are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            question, answer = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            words = [words_of(q) + words_of(a) for q, a in zip(question, answer, strict=True)]
            columns = [
                batch.column(0),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "length", "terms"])

    numbered = items.select(_part(parts).alias("part"), "question", "answer")
    return mapped(numbered, run, "part long, length long, terms array<string>").where("length > 0")


def _part(parts: int):
    return F.pmod(F.xxhash64("item", "question", "answer"), F.lit(parts))


def _indexes(items: DataFrame, per_index: int) -> Iterator[ItemIndex]:
    """Indexes of bounded size over all items, in hash order; all score by the statistics of all items."""
    rows = items.count()
    parts = max(1, -(-rows // per_index))
    if parts == 1:
        yield ItemIndex(_collected(items))
        return
    bags = durable(_bags(items, parts))
    # Where no item has words, there is nothing to score.
    number, mean, longest = bags.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0)), F.max("length")).first()
    terms = bags.select("part", F.explode("terms").alias("term"))
    frequency = durable(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    for part in range(parts):
        own = frequency.join(terms.where(F.col("part") == part), "term", "left_semi")
        whole = Statistics(number, mean, longest or 1, {r["term"]: r["n"] for r in own.collect()})
        yield ItemIndex(_collected(items.where(_part(parts) == part)), whole)


def _collected(items: DataFrame) -> list[tuple]:
    return sorted(map(tuple, items.collect()), key=lambda r: (r[0] is None, r))


def find_test_items(
    texts: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    question: str = "question",
    answer: str = "answer",
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    per_index: int = ITEMS_PER_INDEX,
) -> DataFrame:
    """Every training text with the test items found in it.

    General: the project has no test sets. Each text is cut into overlapping passages; each passage
    queries a BM25 index of the items, and block-max WAND retrieves all that reach ``threshold`` of
    their own score. A retrieved item counts if at least ``overlap`` of the five-word shingles of its question, and
    of its answer, stand in the passage. Texts may hold an item in other case, punctuation and line ends.

    Returns the input columns and ``test_items``: an array of (item, score, question_overlap,
    answer_overlap), one entry per item, empty where nothing was found. Null or empty texts hold
    nothing; an item without words is never found; a null question or answer counts as empty; items with equal texts are all
    found; further columns pass through, and one called ``test_items`` is replaced.

    Texts are not shuffled. An index goes to all tasks and holds at most about ``per_index`` items; for more
    items, the texts pass through one index after another, and all score by the statistics of all items.
    """
    spark = texts.sparkSession
    items = items.select(
        F.col(item).alias("item"), F.col(question).alias("question"), F.col(answer).alias("answer")
    )
    kind = items.schema["item"].dataType.simpleString()
    entry = f"array<struct<item: {kind}, score: double, question_overlap: double, answer_overlap: double>>"
    out = texts.drop("test_items").withColumn("test_items", F.array().cast(entry))
    for index in _indexes(items, per_index):
        out = _pass(out, spark.sparkContext.broadcast(index), text, threshold, overlap)
    return out


def _pass(texts: DataFrame, shared, text: str, threshold: float, overlap: float) -> DataFrame:
    place = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.matches(batch.column(place).to_pylist(), threshold, overlap)
            before = batch.column(batch.num_columns - 1)
            names = ["item", "score", "question_overlap", "answer_overlap"]
            rows = [
                old + [dict(zip(names, m, strict=True)) for m in new]
                for old, new in zip(before.to_pylist(), found, strict=True)
            ]
            columns = [*batch.columns[:-1], pa.array(rows, before.type)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(texts, run, texts.schema)


def question_and_answer(items: DataFrame, text: str = "text") -> DataFrame:
    """Items with ``question`` and ``answer``: the last sentence is the answer if there are several."""
    last = F.regexp_extract(text, r"(?s)^(.*[.!?])\s+([^.!?]*[^\s.!?][^.!?]*[.!?]*\s*)$", 2)
    front = F.regexp_extract(text, r"(?s)^(.*[.!?])\s+([^.!?]*[^\s.!?][^.!?]*[.!?]*\s*)$", 1)
    several = F.length(last) > 0
    return items.withColumn("question", F.when(several, front).otherwise(F.col(text))).withColumn(
        "answer", F.when(several, last)
    )
