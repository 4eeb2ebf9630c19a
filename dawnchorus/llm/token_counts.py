"""Token counts of result files by byte-pair encoding, merged for many words at a time."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dawnchorus.llm.shared import mapped, slices

# Words kept with their counts by one Python worker.
WORDS_REMEMBERED = 400_000
# Words resolved together, and pre-tokens held at once.
PENDING = 200_000
NO_PAIR = np.iinfo(np.int64).max


class RankMerger:
    """Counts the symbols that remain of each word when its pairs are merged by rank.

    All words of a call lie end to end in one array of symbols. In every round each word finds the
    lowest rank among its neighbouring pairs and merges all places of that pair at once; places
    that overlap (a run of one symbol) are taken from the left. Words without a known pair leave.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        pairs = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left = vocab[a] if a in vocab else None
            if left is not None and b in vocab:
                pairs[left * self.size + vocab[b]] = (rank, vocab[self._joined(a, b)])
        keys = sorted(pairs)
        self.keys = np.array(keys, dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in keys], dtype=np.int64)
        signs = _byte_signs()
        self.inner = np.array([vocab[s] for s in signs], dtype=np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in signs], dtype=np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"] if not t.get("normalized")]
        split = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(split) if split else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        # White space is the Unicode property, as in the tokenizer's own engine.
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))

    @staticmethod
    def _joined(a: str, b: str) -> str:
        return a + b

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Words of a text, slice by slice, after canonical composition and lower-casing."""
        for part in slices(text):
            if not part.isascii():
                # Letter by letter: a final sigma is not special.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            yield self.words.findall(part.lower())

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of symbols of every word."""
        out = np.zeros(len(words), dtype=np.int64)
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(lengths)
        filled = lengths > 0
        ids[ends[filled] - 1] = self.last[data[ends[filled] - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(ids):
            rank, new = self._pairs(ids, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_PAIR
            out[owner[starts[done]]] = sizes[done]
            here = np.repeat(best, sizes)
            hit = (rank == here) & (rank != NO_PAIR)
            place = np.arange(len(ids))
            # In a run of hits only every second one can merge.
            begun = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(begun, place, 0))
            hit &= (place - run) % 2 == 0
            ids = np.where(hit, new, ids)
            keep = ~np.r_[False, hit[:-1]] & ~np.repeat(done, sizes)
            ids, owner = ids[keep], owner[keep]
        return out

    def _pairs(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each symbol with its right neighbour in the same word."""
        rank = np.full(len(ids), NO_PAIR, dtype=np.int64)
        new = np.zeros(len(ids), dtype=np.int64)
        left = np.flatnonzero(owner[:-1] == owner[1:])
        if len(left) and len(self.keys):
            key = ids[left] * self.size + ids[left + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            rank[left[known]] = self.ranks[at[known]]
            new[left[known]] = self.merged[at[known]]
        return rank, new


def _byte_signs() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in signs:
            signs[b] = chr(spare)
            spare += 1
    return [signs[b] for b in range(256)]


@functools.cache
def _merger(path: str) -> tuple[RankMerger, dict[str, int]]:
    return RankMerger(path), {}


def _resolve(merger: RankMerger, known: dict[str, int], words: set[str]) -> None:
    """Count the unknown words together."""
    fresh = [w for w in words if w not in known]
    if len(known) + len(fresh) > WORDS_REMEMBERED:
        known.clear()
        fresh = list(words)
    if fresh:
        known.update(zip(fresh, merger.counts(fresh).tolist(), strict=True))


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; words of all texts are merged together."""
    merger, known = _merger(path)
    totals = [0] * len(texts)
    held: list[tuple[int, list[str]]] = []
    size = 0

    def settle() -> None:
        nonlocal size
        _resolve(merger, known, {w for _, words in held for w in words})
        for i, words in held:
            totals[i] += sum(map(known.__getitem__, words))
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        parts = [text]
        if merger.special and "<" in text:
            parts = merger.special.split(text)
            totals[i] += len(parts) - 1
        for part in parts:
            for words in merger.pre_tokens(part):
                held.append((i, words))
                size += len(words)
                if size >= PENDING:
                    settle()
    settle()
    return totals


def result_token_counts(
    results: DataFrame, path: str, limit: int = 2048, file: str = "file", content: str = "content"
) -> DataFrame:
    """Tokens of every result file, for planning how many fit into a model's context.

    ``results`` has one row per result file: its key ``file`` and its whole text ``content``. Returns
    one row per input row: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens). ``path`` names a tokenizer file that executors can read; special strings in a
    text count as the one token they are. Texts are never shortened.

    A null text counts as empty, an empty text has 0 tokens; a null key stays null; repeated rows
    are counted each; further columns are ignored. Rows need no shuffle, and one Python worker holds
    a bounded number of words, whatever the length of a text.
    """
    kind = results.schema[file].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = count_tokens(texts, path)
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[file, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"`{file}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return mapped(results.select(file, content), run, schema)
