"""Language of names and texts: family first, then pairs of related languages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.llm.shared import durable, mapped, slices

# Family of each language code; other codes form a family of their own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu", "se"],
    "turkic": ["az", "kk", "tr", "uz"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "sinitic": ["zh", "zh-cn", "zh-tw"],
}
UNDETERMINED = "und"
FEATURES = 1 << 13
# Labelled rows per language that training reads at most.
SAMPLE_PER_LANGUAGE = 400
# How steeply a margin turns into a probability.
STEEPNESS = 4.0
# Texts multiplied with the weights at once.
BLOCK = 64


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language.lower() in members), language)


def _letters() -> np.ndarray:
    """Code of each character lower-cased; 32 for everything that is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        sign = chr(code)
        if sign.isalpha():
            low = sign.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_table: list[np.ndarray] = []


def features(text: str) -> np.ndarray | None:
    """Hashed counts of letter pairs and triples with word ends, damped and of length 1.

    None if the text has no letter.
    """
    if not _table:
        _table.append(_letters())
    counts = np.zeros(FEATURES)
    for part in slices(text):
        codes = np.frombuffer(f" {part} ".encode("utf-32-le"), dtype=np.uint32)
        codes = _table[0][codes]
        # White space and signs in a row count as one word end.
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        if len(codes) < 3:
            continue
        two = codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519)
        three = two[:-1] * np.uint32(3266489917) + codes[2:] * np.uint32(668265263)
        for mixed in (two, three):
            mixed = mixed ^ (mixed >> np.uint32(15))
            mixed *= np.uint32(2146121005)
            counts += np.bincount(mixed >> np.uint32(19), minlength=FEATURES)
    total = np.sqrt(counts.sum())
    return np.sqrt(counts) / total if total else None


def train_pair(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by dual coordinate descent.

    The last column of ``x`` is 1 in every row. ``x`` is the one large array here; no copy of it is made.
    """
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    # Classes weigh the same, whatever their sizes.
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) * 2 / len(y)
    diagonal = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 0.5 / (cost * share)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / (cost * share[i])
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


class LanguageModel:
    """Pairwise separators between families and between the languages of each family."""

    def __init__(self, languages: list[str], weights: Mapping[tuple[str, str, str], np.ndarray]):
        self.languages = sorted(languages)
        self.families: dict[str, list[str]] = {}
        for name in self.languages:
            self.families.setdefault(family_of(name), []).append(name)
        self.keys = sorted(weights)
        self.matrix = np.array([weights[k] for k in self.keys]).reshape(len(self.keys), FEATURES + 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for at in range(0, len(texts), BLOCK):
            known = [(i, features(t)) for i, t in enumerate(texts[at : at + BLOCK], at) if t]
            known = [(i, f) for i, f in known if f is not None]
            if not known or not self.languages:
                continue
            x = np.hstack([np.array([f for _, f in known]), np.ones((len(known), 1))])
            for (i, _), row in zip(known, x @ self.matrix.T, strict=True):
                margins = dict(zip(self.keys, row, strict=True))
                family, sure = self._winner("family", sorted(self.families), margins)
                name, surely = self._winner(family, self.families[family], margins)
                out[i] = (name, float(sure * surely))
        return out

    @staticmethod
    def _winner(level: str, names: list[str], margins: Mapping[tuple[str, str, str], float]):
        """The name with most pairs won, and its mean probability over its pairs."""
        if len(names) == 1:
            return names[0], 1.0
        chance = {n: 0.0 for n in names}
        wins = dict.fromkeys(names, 0)
        for a, b in combinations(names, 2):
            margin = margins.get((level, a, b), 0.0)
            p = 1 / (1 + np.exp(-STEEPNESS * np.clip(margin, -20, 20)))
            chance[a] += p
            chance[b] += 1 - p
            wins[a if margin >= 0 else b] += 1
        best = max(names, key=lambda n: (wins[n], chance[n]))
        return best, chance[best] / (len(names) - 1)


def train_languages(
    labels: DataFrame,
    label: str = "label",
    language: str = "language",
    sample: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from labelled texts, such as species labels of localised label files.

    Of each language at most ``sample`` rows are read, those with the smallest hash of their text;
    whole texts are used, equal ones once. Every pair of families, and every pair of languages within a family, is
    trained as a group of its own on the executors; only the weights come to the driver. Rows with
    a null text or language are not used.
    """
    rows = labels.select(F.col(label).alias("label"), F.col(language).alias("language"))
    rows = rows.where("label IS NOT NULL AND language IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("label"))
    # Few rows go further: of each language those below the hash that about four times the sample is below. Copies
    # share a hash, so it is the different ones that count.
    counts = rows.groupBy("language").agg(F.approx_count_distinct("h")).collect()
    limits = [(r[0], min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 4 * sample / max(1, r[1]))))) for r in counts]
    table = rows.sparkSession.createDataFrame(limits, "language string, below long")
    near = rows.join(F.broadcast(table), "language").where("h <= below").select("language", "label", "h").distinct()
    first = Window.partitionBy("language").orderBy("h", F.xxhash64(F.reverse("label")))
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
    chosen = durable(chosen.select("label", "language"))
    names = sorted(r[0] for r in chosen.select("language").distinct().collect())
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(family_of(name), []).append(name)
    jobs = [("family", a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    for family, members in families.items():
        jobs += [(family, a, b, [a], [b]) for a, b in combinations(members, 2)]
    if not jobs:
        return LanguageModel(names, {})
    roles = [
        (level, a, b, member, side)
        for level, a, b, left, right in jobs
        for side, members in ((1.0, left), (-1.0, right))
        for member in members
    ]
    table = chosen.sparkSession.createDataFrame(
        roles, "level string, a string, b string, language string, side double"
    )

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "label"])
        x, sides = np.ones((len(group), FEATURES + 1), dtype=np.float32), []
        for text, side in zip(group["label"], group["side"], strict=True):
            found = features(text)
            if found is not None:
                x[len(sides), :FEATURES] = found
                sides.append(side)
        y = np.array(sides)
        if len(set(y)) == 2:
            w = train_pair(x[: len(y)], y)
        else:
            w = np.zeros(FEATURES + 1)
            w[-1] = y[0] if len(y) else 0.0
        head = group.iloc[0]
        return pd.DataFrame({"level": [head["level"]], "a": [head["a"]], "b": [head["b"]], "w": [w.tolist()]})

    # The table of roles is as small as the list of languages.
    grouped = chosen.join(F.broadcast(table), "language").groupBy("level", "a", "b")
    found = grouped.applyInPandas(train, "level string, a string, b string, w array<double>").collect()
    return LanguageModel(names, {(r["level"], r["a"], r["b"]): np.array(r["w"]) for r in found})


def identify_language(
    labels: DataFrame,
    model: LanguageModel,
    key: str = "class_index",
    label: str = "label",
    keep: bool = False,
) -> DataFrame:
    """Language of every label (species name, or any longer text), by ``model``.

    Returns one row per input row: ``key``, ``language`` and ``score`` (0 to 1: the family's
    probability times the language's within it). A null text, or one without letters, is
    ``und`` with score 0; so is every text if the model knows no language. Keys may be null or
    repeated; further columns are ignored, or with ``keep`` all columns are returned before ``language`` and
    ``score`` (which replace columns of these names). Rows need no shuffle; the weights are as many as the pairs of
    languages.
    """
    spark = labels.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = labels.drop("language", "score") if keep else labels.select(key, label)
    place = rows.columns.index(label)
    kept = rows.schema.fields if keep else rows.schema.fields[:1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names) - 2],
                    pa.array([r[0] for r in found], pa.string()),
                    pa.array([r[1] for r in found], pa.float64()),
                ],
                names=names,
            )

    schema = T.StructType([*kept, T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())])
    names = schema.names
    return mapped(rows, run, schema)
