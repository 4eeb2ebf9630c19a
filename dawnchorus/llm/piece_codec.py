"""SentencePiece ids of result files by a table of each prefix's last piece."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_format

from dawnchorus.llm.shared import mapped, slices

SPACE = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6
# Words kept by one Python worker, twice over.
WORDS_REMEMBERED = 100_000
PAIRS_REMEMBERED = 250_000


class PieceCodec:
    """Encodes with a merge-type piece model, and decodes.

    For every prefix of a word the table keeps its one possible last piece. Candidates are the
    pieces that an automaton finds ending there, longest first; a candidate fits if merging its
    text together with the piece before it gives back exactly these two. The ids are then read from
    the end. Words split where no piece can reach across: before a space sign that follows another
    character, and around characters that only bytes can say.
    """

    def __init__(self, path: str):
        spec = model_format.ModelProto()
        with open(path, "rb") as source:
            spec.ParseFromString(source.read())
        self.prefixed = spec.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.said_by_bytes = frozenset(self.byte_of)
        self.end_id = next(i for i, p in enumerate(spec.pieces) if p.type == CONTROL and p.piece == "</s>")
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.scores.items():
            # A piece that merging never makes of its own text can't be the last one.
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.letters = set("".join(self.scores))
        across = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        alone = "" if "\n" in self.letters else "\n"
        self.word = re.compile(
            r"(?s).+" if across else rf"{alone or '(?!)'}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        )
        self.splits = not across
        self.fits: dict[int, bool] = {}
        # Words met lately, and those before them; the older half goes when the newer is full.
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbouring pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, before: int, i: int) -> bool:
        """Whether two pieces stay apart when their texts meet."""
        key = before << 24 | i
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS_REMEMBERED:
                self.fits.clear()
            a, b = self.pieces[before], self.pieces[i]
            found = self.fits[key] = self.merge(a + b) == [a, b]
        return found

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word from its prefix table."""
        n = len(word)
        # Of each prefix the last piece and its length; -1 is a character said by bytes.
        last, lengths = [-1] * (n + 1), [1] * (n + 1)
        fits, letters, filled = self.fits, self.letters, 0
        for end, (length, i) in self.automaton.iter(word):
            end += 1
            if end == filled:
                continue
            start = end - length
            if start:
                before = last[start]
                if before >= 0:
                    fit = fits.get(before << 24 | i)
                    if not (self._fit(before, i) if fit is None else fit):
                        continue
                elif word[start - 1] in letters:
                    a, b = word[start - 1], self.pieces[i]
                    if self.merge(a + b) != [a, b]:
                        continue
            last[end] = i
            lengths[end] = length
            filled = end
        ids: list[int] = []
        at = n
        while at:
            i = last[at]
            if i >= 0:
                ids.append(i)
                at -= lengths[at]
            else:
                at -= 1
                ids.extend(self.bytes[b] for b in reversed(word[at].encode("utf-8")))
        ids.reverse()
        return ids

    def words(self, text: str) -> Iterator[list[str]]:
        """Words of a text with space signs, slice by slice."""
        first = True
        for part in slices(text) if self.splits else [text]:
            if not part:
                continue
            part = part.replace(" ", SPACE)
            if first and self.prefixed:
                part = SPACE + part
            first = False
            yield self.word.findall(part)

    def spelled(self, word: str) -> tuple[str, str, int]:
        """Ids of a word as decimal text, what they decode to, and how many they are."""
        found = self.older.get(word)
        if found is None:
            ids = self.word_ids(word)
            found = (" ".join(map(str, ids)), self.decoded(ids), len(ids))
        if len(self.known) >= WORDS_REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[word] = found
        return found

    def decoded(self, ids: list[int]) -> str:
        """Text of ids with a space for each space sign; control ids say nothing."""
        if self.said_by_bytes.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids if self.kinds[i] != CONTROL]).replace(SPACE, " ")
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id included."""
        return [i for ws in self.words(text) for w in ws for i in self.word_ids(w)] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for, without the space added in front."""
        return self._bare(self.decoded(ids))

    def _bare(self, text: str) -> str:
        return text[1:] if self.prefixed and text.startswith(" ") else text

    def digest(self, text: str, kept: list[np.ndarray] | None = None) -> tuple[int, str, str, str]:
        """(number of ids, digest of the ids, digest of the decoded text, decoded text).

        The ids themselves go to ``kept``, slice by slice, if it is given.
        """
        ids, out, n = hashlib.sha256(), [], 1
        for words in self.words(text):
            get, spelled = self.known.get, self.spelled
            found = [get(w) or spelled(w) for w in words]
            said = " ".join([f[0] for f in found])
            ids.update((said + " ").encode("ascii"))
            if kept is not None:
                kept.append(np.fromstring(said, dtype=np.int32, sep=" "))
            out.append("".join([f[1] for f in found]))
            n += sum([f[2] for f in found])
        ids.update(str(self.end_id).encode("ascii"))
        if kept is not None:
            kept.append(np.array([self.end_id], dtype=np.int32))
        back = self._bare("".join(out))
        return n, ids.hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest(), back


@functools.cache
def _codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def piece_round_trip(
    results: DataFrame,
    path: str,
    file: str = "file",
    content: str = "content",
    keep_ids: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """Encode the text of every result file into piece ids and decode it again.

    ``results`` has one row per result file: its key ``file`` and its whole text ``content``. Returns
    one row per input row: the key, ``n_tokens`` (the end id included), ``ids_sha256`` (of the decimal
    ids joined by a space), ``decoded_sha256``; with ``keep_ids`` also ``ids``, with ``keep_text`` also
    ``decoded``. ``path`` names a model file that executors can read.

    A null text counts as empty, which gives the end id alone; a null key stays null; repeated
    rows are encoded each; further columns are ignored. No shuffle; a worker remembers a bounded
    number of words and pairs.
    """
    kind = results.schema[file].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            held: list[list[np.ndarray]] = [[] for _ in texts]
            rows = [codec.digest(t, h if keep_ids else None) for t, h in zip(texts, held, strict=True)]
            arrays = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            names = [file, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array([np.concatenate(h) for h in held], pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                arrays.append(pa.array([r[3] for r in rows], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{file}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return mapped(results.select(file, content), run, schema)
