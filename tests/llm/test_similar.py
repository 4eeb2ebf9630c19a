"""Classes of similar texts against all pairs, and the near-duplicate stage of the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
from dawnchorus.llm import similar as similar_module
from dawnchorus.llm.shared import durable
from dawnchorus.llm.simhash import fingerprint
from dawnchorus.llm.similar import keep_first_similar, shingles, similar, similar_classes
from dawnchorus.scale import possibly_among, without


def _texts() -> list[str | None]:
    draw = random.Random(3)
    out: list[str | None] = [None, "", "one two", "ONE two", "one two three"]
    for n in (12, 25, 60, 200):
        base = [f"w{draw.randrange(5000)}" for _ in range(n)]
        for changes in range(12):
            words = list(base)
            for _ in range(draw.randrange(changes + 1)):
                words[draw.randrange(n)] = f"x{draw.randrange(5000)}"
            out.append(" ".join(words))
            out.append(" ".join(base[: n - draw.randrange(1 + n // 4)]))
    return out


def test_classes_equal_all_pairs(spark):
    texts = _texts()
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] == sets[j] or similar(sets[i], sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "file long, content string, other string")
    got = {r["file"]: r["component_id"] for r in similar_classes(table).collect()}
    assert got == dict(enumerate(root))
    kept = keep_first_similar(table)
    assert kept.columns == table.columns
    assert {r["file"] for r in kept.collect()} == set(root) and len(set(root)) < len(texts)


def test_the_stage_links_texts_of_one_changed_word(spark):
    draw = random.Random(5)
    rows = []
    for k in range(20):
        words = [f"w{draw.randrange(9000)}" for _ in range(60)]
        for copy in range(2):
            words[30 * copy] = f"y{k}"
            rows.append((2 * k + copy, " ".join(words), "en", "s", 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert {r["doc_id"] for r in left.collect()} == set(range(0, 40, 2))


def test_the_stage_takes_simhash_classes_and_confirms_them(spark, monkeypatch):
    draw = random.Random(7)
    long = [f"w{draw.randrange(9000)}" for _ in range(4000)]
    other = [f"v{draw.randrange(9000)}" for _ in range(4000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long, "tail"])), (3, " ".join(other)), (4, None), (5, "")]
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    named, checked = [], []
    pairs, verified = similar_module.simhash_pairs, similar_module._verified

    def noted_pairs(*args):
        named.extend(tuple(r) for r in pairs(*args).select("u", "v").collect())
        return pairs(*args)

    def noted_checks(asked, texts):
        checked.append({tuple(r) for r in asked.select("u", "v").collect()})
        return verified(asked, texts)

    monkeypatch.setattr(similar_module, "simhash_pairs", noted_pairs)
    monkeypatch.setattr(similar_module, "_verified", noted_checks)
    left = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert {r["doc_id"] for r in left.collect()} == {1, 3, 4}
    assert named == [(1, 2)] and (1, 2) in checked[0]


def test_only_texts_of_a_pair_are_shuffled_whatever_size_is_estimated(spark):
    texts = spark.range(1000).selectExpr("id AS file", "concat('a b c d e f g ', id DIV 2) AS content")
    many = spark.range(1000000)
    # Estimated at the product of both sides.
    pairs = durable(many.join(many, "id").where("id = 6").selectExpr("id AS u", "id + 1 AS v"))
    found = similar_module._verified(pairs, texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan
    assert [tuple(r) for r in found.collect()] == [(6, 7)]


def test_possibly_among_keeps_all_that_are_and_few_others(spark):
    rows = spark.range(20000).selectExpr("cast(id AS string) AS file", "id").unionByName(spark.sql("SELECT cast(null AS string) AS file, -1L AS id"))
    keys = rows.where("id % 50 = 0 OR id < 0").select("file")
    got = {r["id"] for r in possibly_among(rows, keys.unionAll(keys), "file").collect()}
    assert got >= set(range(0, 20000, 50)) and -1 not in got and len(got) < 400 + 20000 // 16
    assert possibly_among(rows, keys.limit(0), "file").count() == 0


def _classes_by_all_pairs(texts: list[str]) -> list[int]:
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if similar(sets[i], sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_texts_that_share_passages_by_chance_are_not_compared(spark, monkeypatch):
    draw = random.Random(11)
    texts = [[" ".join(f"w{k}x{draw.randrange(9000)}" for _ in range(12)) for _ in range(draw.randrange(27, 32))] for k in range(60)]
    # Each in three texts, too few to count as common.
    for _ in range(400):
        phrase = " ".join(f"p{draw.randrange(9000)}" for _ in range(6))
        for parts in draw.sample(texts, 3):
            parts.insert(draw.randrange(len(parts)), phrase)
    texts = [" ".join(parts) for parts in texts]
    # One text cut to just 0.8 of its shingles, one to less.
    words = texts[7].split()
    n = len(words) - 4
    texts += [" ".join(words[: -(-4 * n // 5) + 4]), " ".join(words[: 3 * n // 4])]
    compared = []
    verified = similar_module._verified

    def noted(pairs, whole):
        compared.extend(tuple(r) for r in pairs.select("u", "v").collect())
        return verified(pairs, whole)

    monkeypatch.setattr(similar_module, "_verified", noted)
    table = spark.createDataFrame(list(enumerate(texts)), "file long, content string")
    got = {r["file"]: r["component_id"] for r in similar_classes(table).collect()}
    root = _classes_by_all_pairs(texts)
    assert got == dict(enumerate(root)) and root[60] == 7
    # Hundreds of pairs share a shingle of their prefixes.
    assert (7, 60) in compared and len(compared) < 40


def test_classes_of_texts_from_a_pool_of_sentences_equal_all_pairs(spark):
    draw = random.Random(13)
    pool = [" ".join(f"p{draw.randrange(300)}" for _ in range(draw.randrange(5, 12))) for _ in range(24)]
    texts = [" ".join(draw.sample(pool, draw.randrange(6, 9))) for _ in range(50)]
    for text in texts[:25]:
        words = text.split()
        for _ in range(2):
            words[draw.randrange(len(words))] = f"y{draw.randrange(99)}"
            texts.append(" ".join(words[: len(words) - draw.randrange(1 + len(words) // 5)]))
    root = _classes_by_all_pairs(texts)
    got = {r["file"]: r["component_id"] for r in similar_classes(spark.createDataFrame(list(enumerate(texts)), "file long, content string")).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts)


def test_without_drops_the_keys_alone_and_tells_nulls_apart(spark):
    rows = spark.range(3000).selectExpr("if(id < 6, null, id DIV 2) AS a", "if(id % 3 = 0, null, id % 3) AS b", "id")
    keys = [(None, 1), (50, None), (51, 1), (60, 2), (None, None), (9999, 1)]
    left = without(rows, spark.createDataFrame(keys, "a long, b long"))
    assert left.columns == ["a", "b", "id"]
    want = [tuple(r) for r in rows.collect() if (r["a"], r["b"]) not in keys]
    got = [tuple(r) for r in left.collect()]
    assert sorted(got, key=lambda r: r[2]) == want and len(want) < 3000
    assert without(rows, rows.select("a", "b").limit(0)).count() == 3000
    plan = without(rows, spark.createDataFrame(keys, "a long, b long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "rightHint=(strategy=broadcast)" in plan


def test_dropping_copies_shuffles_only_what_may_go(spark):
    table = spark.createDataFrame([(i, f"a b c d e f {i % 90}") for i in range(100)] + [(None, "n o p"), (3, "a b c d e f 3")], "doc_id long, text string")
    kept = keep_first_similar(table, "doc_id", "text")
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(90), 3, None], key=str)
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()


def test_the_stage_drops_all_but_the_first_of_a_simhash_class(spark):
    draw = random.Random(1692)
    words = [f"w{draw.randrange(9000)}" for _ in range(400)]
    near = list(words)
    for at in draw.sample(range(400), 11):
        near[at] = f"y{draw.randrange(99)}"
    texts = [" ".join(words), " ".join(near)]
    # One bit apart, but less alike than the words ask for.
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() == 1
    assert not similar(shingles(texts[0]), shingles(texts[1]))
    other = " ".join(f"v{draw.randrange(9000)}" for _ in range(400))
    # A copy of the near one, and a text like the near one alone.
    rows = [(8, texts[0]), (2, texts[1]), (5, texts[1].upper()), (9, texts[1] + " tail"), (3, other), (7, None)]
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert {r["doc_id"] for r in left.collect()} == {2, 3, 7}
