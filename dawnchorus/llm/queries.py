"""The check queries of the text operators, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.llm.chat_format import conversation_digests
from dawnchorus.llm.decontaminate import find_test_items, question_and_answer
from dawnchorus.llm.language import identify_language, train_languages
from dawnchorus.llm.line_dedup import remove_repeated_lines
from dawnchorus.llm.main_text import page_texts
from dawnchorus.llm.merkle import result_fingerprints
from dawnchorus.llm.nearest import similar_segments
from dawnchorus.llm.piece_codec import piece_round_trip
from dawnchorus.llm.repeats import repeated_phrases
from dawnchorus.llm.revisits import RESPONSE, REVISIT, resolve_revisits
from dawnchorus.llm.simhash import near_duplicate_classes
from dawnchorus.llm.token_counts import result_token_counts
from dawnchorus.llm.trie import call_trie, ends_digest, in_order

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
# A page is asked for again after so many other captures.
REVISIT_AFTER = 1000
_MARKS = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as result files."""
    return _table(spark, folder, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = remove_repeated_lines(_results(spark, folder))
    return rows.select(
        F.col("file").alias("doc_id"),
        F.col("content").alias("text"),
        F.size("removed").cast("long").alias("n_spans"),
        F.expr("aggregate(removed, 0L, (a, s) -> a + s.end - s.start)").alias("removed_bytes"),
    )


def test_items(spark: SparkSession, folder: str) -> DataFrame:
    return question_and_answer(_table(spark, folder, "benchmark"))


def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    texts = _table(spark, folder, "documents").select("doc_id", "text")
    found = find_test_items(texts, test_items(spark, folder))
    return found.select("doc_id", F.inline("test_items")).select(
        "doc_id",
        F.col("item").alias("item_id"),
        F.round("score", 6).alias("score"),
        F.round("question_overlap", 6).alias("question_overlap"),
        F.round("answer_overlap", 6).alias("answer_overlap"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Pages as an archive: a full response each, and a conditional request some captures later.

    The later request names the entity tag of the page it saw, so it is answered by that page unless
    another response of the same address came between.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    when = F.col("page_id").cast("string")
    full = F.create_map(
        F.lit("ETag"), tag, F.lit("Content-Length"), size, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), when
    )
    again = F.create_map(
        F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"),
        F.lit("Date"), (F.col("page_id") + REVISIT_AFTER).cast("string"), F.lit("Set-Cookie"), F.lit("s=1"),
    )
    first = pages.select(
        F.concat(F.lit("r"), when).alias("capture_id"),
        "url",
        F.col("page_id").alias("captured_at"),
        F.lit(RESPONSE).alias("kind"),
        full.alias("headers"),
    )
    second = pages.select(
        F.concat(F.lit("v"), when).alias("capture_id"),
        "url",
        (F.col("page_id") + REVISIT_AFTER).alias("captured_at"),
        F.lit(REVISIT).alias("kind"),
        again.alias("headers"),
    )
    return first.unionByName(second)


def revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve_revisits(captures(_table(spark, folder, "pages")))
    fields = F.array_sort(
        F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    )
    return found.select(
        "capture_id", "url_key", "response_id", "response_at", "outcome", F.array_join(fields, "\n").alias("header_lines")
    )


REVISITS_SQL = f"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') AS b
  FROM pages
), parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS asked
  FROM bare
), keyed AS (
  SELECT page_id, coalesce(html, '') AS html,
    host || path || CASE WHEN asked = '' THEN '' ELSE '?' || asked END AS url_key
  FROM parts
), responses AS (
  SELECT url_key, page_id AS seen, max('r' || page_id::VARCHAR) AS id,
    arg_max('"' || md5(html) || '"', 'r' || page_id::VARCHAR) AS tag,
    arg_max(octet_length(encode(html))::VARCHAR, 'r' || page_id::VARCHAR) AS size
  FROM keyed GROUP BY url_key, page_id
), joined AS (
  SELECT 'v' || k.page_id::VARCHAR AS capture_id, k.url_key, r.id AS response_id, r.seen AS response_at,
    '"' || md5(k.html) || '"' AS tag, r.tag AS stored, r.size, k.page_id + {REVISIT_AFTER} AS again
  FROM keyed k ASOF LEFT JOIN responses r
    ON k.url_key = r.url_key AND k.page_id + {REVISIT_AFTER} > r.seen
)
SELECT capture_id, url_key, response_id, response_at,
  CASE WHEN response_id IS NULL THEN 'missing' WHEN tag = stored THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN tag = stored THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || again::VARCHAR || chr(10) || 'etag: W/' || tag END AS header_lines
FROM joined
"""


def merkle(spark: SparkSession, folder: str) -> DataFrame:
    return result_fingerprints(_results(spark, folder)).withColumnRenamed("file", "doc_id")


def simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_classes(_results(spark, folder)).withColumnRenamed("file", "doc_id")


def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(_table(spark, folder, "pages"))


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _MARKS), (-1, 1, "assistant", _MARKS)], turns.schema)
    return conversation_digests(turns.unionByName(extra)).withColumnRenamed("conversation", "conv_id")


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def language_model(documents: DataFrame):
    """Learned from the documents that are not held out, as labelled texts."""
    seen = documents.where(~held_out()).select(F.col("text").alias("label"), F.col("lang").alias("language"))
    return train_languages(seen)


def languages(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify_language(documents, language_model(documents), "doc_id", "text")
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"),
        "score",
    )


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = result_token_counts(_results(spark, folder), public_tokenizers.path(WORD_TOKENIZER))
    return counted.withColumnRenamed("file", "doc_id")


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    coded = piece_round_trip(_results(spark, folder), public_tokenizers.path(PIECE_MODEL))
    return coded.withColumnRenamed("file", "doc_id")


def label_lists(documents: DataFrame) -> DataFrame:
    """Documents as label tracks: their words in order; every tenth ends in a repetition, chosen by its key's checksum."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    check = F.crc32(F.col("doc_id").cast("string"))
    counted = documents.select("doc_id", words.alias("w"), check.alias("h"), F.floor(check / 10).alias("g"))
    at = counted.select("*", (F.col("g") % F.nullif(F.size("w"), F.lit(0))).alias("a"))
    period = 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))
    made = at.select("*", period.alias("p"))
    numbers = F.expr("sequence(0, size(w) - 1)")
    a, p = F.col("a"), F.col("p")
    tail = F.transform(numbers, lambda i: F.get("w", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
    repeated = (F.col("h") % 10 == 0) & (F.size("w") > 0)
    return made.select(F.col("doc_id").alias("file"), F.when(repeated, tail).otherwise(F.col("w")).alias("labels"))


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_phrases(label_lists(_table(spark, folder, "documents").select("doc_id", "text")))
    # Of equal length over period the first stays; runs are ordered by start, then period.
    best = F.expr(
        "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), "
        "(m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))"
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        F.col("file").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.array_join("collapsed", " "), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def _shared_first(key: str = "conv_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(6))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as recordings that begin alike: (calls, recordings).

    Each takes its first turns, as many as its key's checksum says, from the conversation whose key is the next lower multiple of 100.
    """
    empty = F.lit("")
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = in_order(turns, "conv_id", order, "place").drop("_part", "turn")
    every = placed.where("place = 1").select("conv_id")
    wants = every.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("from"), _shared_first().alias("h"))
    first = placed.where("place <= 5 AND conv_id % 100 = 0").withColumnRenamed("conv_id", "from")
    taken = wants.join(first, "from").where("place <= h").select("conv_id", "place", "role", "text")
    own = placed.where(F.col("place") > _shared_first()).select("conv_id", "place", "role", "text")
    return taken.unionByName(own), every


def trie(spark: SparkSession, folder: str) -> DataFrame:
    calls, recordings = rebuilt(_table(spark, folder, "conversations"))
    found = call_trie(calls, recordings, "conv_id", at="place", name="role", label="text")
    digests = ends_digest(found.ends)
    return found.nodes.join(digests, "node", "left").select(
        F.col("file").alias("conv_id"),
        "depth",
        F.col("parent_file").alias("parent_conv_id"),
        F.col("n_recordings").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved_chars").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)
), joined AS (
  SELECT v.c, t.d, t.r, t.t FROM convs v JOIN turns t ON t.c = v.base AND t.d <= v.h
  UNION ALL SELECT v.c, t.d, t.r, t.t FROM convs v JOIN turns t ON t.c = v.c AND t.d > v.h
), paths AS (
  SELECT v.c, coalesce(list({'r': j.r, 't': j.t} ORDER BY j.d) FILTER (WHERE j.d IS NOT NULL), []) AS p
  FROM convs v LEFT JOIN joined j ON j.c = v.c GROUP BY v.c
), members AS (
  SELECT c, n AS depth, list_slice(p, 1, n) AS k, n = len(p) AS is_end FROM paths, unnest(range(len(p) + 1)) u(n)
), nodes AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '') AS ends
  FROM members GROUP BY depth, k
), children AS (
  SELECT depth - 1 AS depth, list_slice(k, 1, depth - 1) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), own AS (
  SELECT n.*, coalesce(ch.n, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.k[n.depth].t) END AS saved
  FROM nodes n LEFT JOIN children ch ON ch.depth = n.depth AND ch.k = n.k
), sums AS (
  SELECT e AS depth, list_slice(k, 1, e) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
  FROM own, unnest(range(depth + 1)) u(e) GROUP BY 1, 2
)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN sums s ON s.depth = o.depth AND s.k = o.k
LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.k = list_slice(o.k, 1, o.depth - 1)
"""


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = similar_segments(vectors, vectors.where("vec_id % 100 = 0"), keys=["vec_id"])
    return found.select(F.col("query_vec_id").alias("query_id"), "rank", "vec_id", "score")


NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup,
    "op2_decontaminate": decontaminate,
    "op3_revisits": revisits,
    "op4_merkle": merkle,
    "op5_simhash": simhash,
    "op6_main_text": main_text,
    "op7_chat_format": chat_format,
    "op8_language": languages,
    "op9_token_counts": token_counts,
    "op10_pieces": pieces,
    "op11_repeats": repeats,
    "op12_trie": trie,
    "op13_nearest": nearest,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {"op3_revisits": REVISITS_SQL, "op12_trie": TRIE_SQL, "op13_nearest": NEAREST_SQL}
