"""Merkle fingerprints of result texts: sections, paragraphs and runs of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a leaf.
LEAF_WORDS = 4
# Rows of one block of neighbours on average, and the most blocks.
BLOCK_ROWS = 1024
MAX_BLOCKS = 1 << 14
# Keys read to place the blocks' bounds, for each block.
KEYS_PER_BLOCK = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paragraph(text: Column) -> Column:
    """(h, s): the hash over all leaf hashes, and ``hash=leaf,leaf,…`` with half of each leaf hash shown."""

    def runs(words: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / LEAF_WORDS).cast("int"))
        return F.transform(numbers, lambda i: F.xxhash64(F.slice(words, i * LEAF_WORDS + 1, LEAF_WORDS)))

    def node(hashes: Column) -> Column:
        shown = F.array_join(F.transform(hashes, lambda h: F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), ",")
        own = F.xxhash64(hashes)
        return F.struct(own.alias("h"), F.concat(F.hex(own), F.lit("="), shown).alias("s"))

    return _let(_let(F.split(text, " "), runs), node)


def _section(text: Column) -> Column:
    """(h, s): the hash over the paragraphs' hashes, and ``hash:paragraph;paragraph;…``."""

    def node(parts: Column) -> Column:
        own = F.xxhash64(parts["h"])
        return F.struct(own.alias("h"), F.concat(F.hex(own), F.lit(":"), F.array_join(parts["s"], ";")).alias("s"))

    return _let(F.transform(F.split(text, "\n"), _paragraph), node)


def merkle_fingerprint(text: Column) -> Column:
    """``root/section|section|…`` of a text (null: empty).

    Sections are what blank lines separate, paragraphs are lines, leaves are runs of four words of a
    paragraph, a word being what stands between spaces. Every node's hash covers its children's, so equal texts, and only
    they, have equal roots.
    """

    def node(sections: Column) -> Column:
        own = F.sha2(F.array_join(F.transform(sections["h"], lambda h: F.hex(h)), "|"), 256)
        return F.concat(F.substring(own, 1, 32), F.lit("/"), F.array_join(sections["s"], "|"))

    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _section)
    return F.lower(_let(sections, node))


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 32)


def leaf_hashes(fingerprint: Column) -> Column:
    """The distinct leaves."""
    bare = F.regexp_replace(F.substring(fingerprint, 34, 2**31 - 1), "[0-9a-f]+[:=]", "")
    return F.array_distinct(F.filter(F.split(bare, "[|;,]"), lambda h: h != ""))


def paragraph_hashes(fingerprint: Column) -> Column:
    return F.regexp_extract_all(F.substring(fingerprint, 34, 2**31 - 1), F.lit("([0-9a-f]+)="), F.lit(1))


def edited_paragraphs(before: Column, after: Column) -> Column:
    """Hashes of the paragraphs of ``after`` that ``before`` does not have; none if the roots are equal."""
    new = F.array_except(paragraph_hashes(after), paragraph_hashes(before))
    return F.when(root(before) == root(after), F.array().cast("array<string>")).otherwise(new)


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """1 for equal roots; else the share of distinct leaves in common: twice those of both over those of each."""
    total = F.size(leaves_a) + F.size(leaves_b)
    share = F.when(total > 0, 2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / total).otherwise(0.0)
    return F.when(root(a) == root(b), 1.0).otherwise(share)


def with_next(results: DataFrame, file: str, content: str, keep: dict[str, Column]) -> DataFrame:
    """Rows (file, content, keep…) with ``next_…`` of content and keep: those of the next key.

    After the last key comes the first; equal keys are ordered by content. Keys are cut into blocks at
    bounds that are keys themselves; the row at a bound also stands, as a guest, at the end of the block
    before, so that all neighbours meet with one shuffle. Bounds come from a bounded sample of the keys and
    only decide how even the blocks are.
    """
    rows = results.select(F.col(file).alias("file"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    keyed = rows.where("file IS NOT NULL")
    n, least = keyed.agg(F.count(F.lit(1)), F.min("file")).first()
    blocks = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    drawn = keyed.select("file").orderBy(F.xxhash64("file")).limit(blocks * KEYS_PER_BLOCK).collect()
    drawn = sorted({r[0] for r in drawn})
    step = max(1, len(drawn) // blocks)
    bounds = sorted({least, *drawn[step::step]}) if n else []
    # Two levels of bounds, so that a key is compared with few of them.
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    kind = results.schema[file].dataType.simpleString()
    key = F.col("file")

    def table(values: list) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")

    group = F.size(F.filter(table([g[0] for g in groups if g]), lambda b: b <= key))
    members = F.element_at(F.array(*[table(g) for g in groups]), F.greatest(group, F.lit(1)))
    within = F.size(F.filter(members, lambda b: b <= key))
    block = (group - 1) * width + within - 1
    at_bound = F.array_contains(members, key)
    before = F.when(block == 0, F.lit(max(0, len(bounds) - 1))).otherwise(block - 1)
    # Rows without a key have no neighbours; each is alone.
    place = F.when(key.isNull(), F.array(F.struct(F.lit(-1).alias("block"), F.lit(False).alias("guest"))))
    place = place.when(
        at_bound,
        F.array(
            F.struct(block.alias("block"), F.lit(False).alias("guest")),
            F.struct(before.alias("block"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(block.alias("block"), F.lit(False).alias("guest"))))
    spread = rows.select("*", F.inline(place))
    alone = F.when(F.col("block") < 0, F.xxhash64("content")).otherwise(0)
    spread = spread.withColumn("alone", alone).repartition("block", "alone")
    for name, column in keep.items():
        spread = spread.withColumn(name, column)
    order = Window.partitionBy("block", "alone").orderBy("guest", "file", "content")
    following = [
        F.when(F.col("block") >= 0, F.lead(c).over(order)).alias(f"next_{c}") for c in ("content", *keep)
    ]
    return spread.select("file", "content", *keep, "guest", *following).where("NOT guest").drop("guest")


def result_fingerprints(results: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Merkle fingerprints of every result text, of an edit of it, and their likeness.

    The edited text has its last half (rounded down) replaced by as much of the start of the next
    file's text, in the order of keys; after the last comes the first. Returns one row per input
    row: the key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` (likeness to the edited text, to the next file's text) and ``edited_paragraphs``, where the
    branches differ. Column functions only.

    A null text counts as empty. A row without a key has no next: what is cut is not replaced, and
    ``near_next`` is null. Repeated keys follow one another by content; a single row is its own next;
    further columns are ignored.
    """
    rows = with_next(results, file, content, {"fingerprint": merkle_fingerprint(F.col("content"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("content").cast("long"))
    edited = F.concat(
        F.substring(F.col("content"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.coalesce("next_content", F.lit("")), F.lit(1), half),
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", merkle_fingerprint(F.col("edited")))
    fingerprint, changed, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    own, edit, ahead = F.col("own_leaves"), F.col("edited_leaves"), F.col("next_leaves")
    rows = rows.withColumns(
        {
            "own_leaves": leaf_hashes(fingerprint),
            "edited_leaves": leaf_hashes(changed),
            "next_leaves": leaf_hashes(following),
        }
    )
    return rows.select(
        F.col("file").alias(file),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint,
        changed,
        likeness(fingerprint, changed, own, edit).alias("near_edited"),
        F.when(following.isNotNull(), likeness(fingerprint, following, own, ahead)).alias("near_next"),
        edited_paragraphs(fingerprint, changed).alias("edited_paragraphs"),
    )
