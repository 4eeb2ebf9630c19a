"""Text operators against plain restatements, on small tables with nulls, ties and odd texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from dawnchorus.llm import line_dedup, simhash
from dawnchorus.llm.chat_format import conversation_digests, format_turn, parse, read_back
from dawnchorus.llm.decontaminate import ItemIndex, find_test_items, question_and_answer, words_of
from dawnchorus.llm.language import UNDETERMINED, identify_language, train_languages
from dawnchorus.llm.line_dedup import remove_repeated_lines
from dawnchorus.llm.main_text import extract, page_texts
from dawnchorus.llm.merkle import result_fingerprints
from dawnchorus.llm.piece_codec import PieceCodec, piece_round_trip
from dawnchorus.llm.revisits import canonical_url, resolve_revisits
from dawnchorus.llm.shared import connected, slices
from dawnchorus.llm.simhash import keep_first, near_duplicate_classes
from dawnchorus.llm.token_counts import count_tokens, result_token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a  b ", "\n", "a" * 3000, "!" * 999, "Merula\tmerula\r\n", "日本語 😀😀", "don't I'LL x", "É é ﬁ ² Ⅷ ½",
    "<|endoftext|> x<|startoftext|>", "\x00 x", "▁▁ x▁", "aaa bb ab " * 300, "<s> </s> <0x41>", "İ ΑΣ ß", "한국어ABC123",
]
FILES = "file long, content string"


def results(spark, rows):
    return spark.createDataFrame(rows, FILES)


def words(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefgh"), draw.integers(3, 9))) for _ in range(n))


def test_slices_lose_nothing():
    for text in [*ODD, words(1, 500)]:
        assert "".join(slices(text, 7)) == text


def test_connected_matches_union_find(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r[0]: r[1] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for e in edges for x in e if find(x) != x}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    texts = [*ODD, *(words(i, 80) for i in range(30))]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert count_tokens(texts, WORD) == want
    rows = result_token_counts(
        results(spark, [*enumerate(texts), (None, "a b"), (5, None)]).withColumn("n_tokens", F.lit("x")), WORD, limit=3
    ).collect()
    assert Counter(r["n_tokens"] for r in rows) == Counter([*want, 2, 0])
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in rows)


def test_pieces_match_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    codec = PieceCodec(PIECE)
    for text in [*ODD, *(words(i, 80) for i in range(30))]:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)
    rows = piece_round_trip(results(spark, [(1, "a b"), (2, None), (None, "")]), PIECE, keep_ids=True).collect()
    by_key = {r["file"]: r for r in rows}
    assert by_key[1]["ids"] == library.encode("a b", add_eos=True)
    assert by_key[2]["ids"] == by_key[None]["ids"] == [2]
    assert by_key[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, by_key[1]["ids"])).encode()).hexdigest()


def brute_simhash(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes_match_brute_force(spark):
    base = words(9, 400).split()
    texts = [*ODD, None]
    for i in range(60):
        copy = list(base)
        copy[i * 5] = f"w{i}"
        texts.append(" ".join(copy))
    marks = [brute_simhash(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if bin(marks[a] ^ marks[b]).count("1") <= 2:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    table = results(spark, list(enumerate(texts)))
    rows = near_duplicate_classes(table).collect()
    assert {r["file"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{m:016x}", root[i]) for i, m in enumerate(marks)
    }
    assert {r["file"] for r in keep_first(table).collect()} == set(root)
    assert near_duplicate_classes(results(spark, [])).count() == 0
    some = {r["file"]: r["component_id"] for r in near_duplicate_classes(results(spark, [(None, "q"), (4, "q")])).collect()}
    assert some == {None: 4, 4: 4}


def test_vantage_point_shards_meet_every_pair_once():
    draw = np.random.default_rng(4)
    centres = draw.integers(0, 2**63, 50, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (3000, 2)).astype(np.uint64)
    values = np.unique(np.r_[centres, centres[draw.integers(0, 50, 3000)] ^ flips[:, 0] ^ flips[:, 1]])
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    want = {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b}
    rows, shard, home = simhash.route(values, simhash.shard_tree(values[::7], 5), 2)
    met = []
    for s in np.unique(shard):
        own, asking = rows[(shard == s) & home], rows[(shard == s) & ~home]
        both = np.r_[own, asking]
        for a, b in simhash.links(values[own], values[asking], 2):
            met += [tuple(sorted(p)) for p in zip(both[a].tolist(), both[b].tolist(), strict=True)]
    assert len(met) == len(set(met)) and set(met) == want


@pytest.mark.parametrize("bounded", [True, False])
def test_repeated_passages_are_cut_once(spark, monkeypatch, bounded):
    if not bounded:
        monkeypatch.setattr(line_dedup, "_bounded", lambda side: False)
    passage = words(77, 55)
    texts = {i: f"{words(i, 120)} {passage} {words(100 + i, 90)}" for i in range(6)}
    texts[6] = texts[2]
    texts[7] = words(7, 200)
    texts[8] = f"Short é line.\nAnother.\n{words(8, 20)}"
    texts[9] = texts[8]
    rows = [*texts.items(), (20, None), (None, texts[0]), (21, "")]
    table = results(spark, rows).withColumn("removed", F.lit(1)).withColumn("source", F.lit("s"))
    out = remove_repeated_lines(table)
    assert out.columns == ["file", "source", "content", "removed"]
    got = {r["file"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert got[0]["content"] == texts[0] and passage in got[0]["content"]
    for i in range(1, 6):
        assert got[i]["content"] == f"{words(i, 120)} {words(100 + i, 90)}"
    assert got[6]["content"] == ""
    for i in (7, 8, 9):
        assert got[i]["content"] == texts[i] and got[i]["removed"] == []
    assert got[20]["content"] is None and got[21]["content"] == "" and got[None]["content"] == texts[0]
    assert remove_repeated_lines(results(spark, [])).count() == 0


def test_equal_spans_end_at_words():
    yes, no = (True, True), (False, False)
    assert line_dedup.equal_spans(b"xx one two three yy", b"zz one two threes y", 1, yes, yes) == [(3, 11)]
    assert line_dedup.equal_spans(b"one two", b"one two", 2, yes, yes) == [(0, 7)]
    assert line_dedup.equal_spans(b"one two", b"one two", 3, yes, yes) == []
    assert line_dedup.equal_spans(b"one two six", b"one two six", 1, (True, False), no) == [(4, 8)]
    assert line_dedup.equal_spans(b"one two", b"one twos", 1, yes, (True, True)) == [(0, 4)]
    assert line_dedup.equal_spans(b"", b"x", 1, yes, yes) == []


def test_block_max_wand_equals_full_scoring():
    draw = np.random.default_rng(6)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(draw.choice(vocabulary, draw.integers(3, 25))), None) for i in range(80)]
    index = ItemIndex(items)
    for _ in range(200):
        asked = set(draw.choice(vocabulary, draw.integers(1, 40)).tolist())
        for threshold in (0.2, 0.5, 0.9):
            want = {}
            for term in asked & set(index.lists):
                for n, share in zip(*index.lists[term][:2], strict=True):
                    want[n] = want.get(n, 0) + share
            found = dict(index.retrieve(asked, threshold))
            assert set(found) == {n for n, s in want.items() if s >= threshold - 1e-9}
            assert all(abs(found[n] - want[n]) < 1e-9 for n in found)


@pytest.mark.parametrize("per_index", [4096, 2])
def test_items_are_found_whole_and_alone(spark, per_index):
    questions = [words(500 + i, 30) for i in range(5)]
    items = spark.createDataFrame(
        [(i, q, f"Answer {words(600 + i, 6)}.") for i, q in enumerate(questions)] + [(9, None, None), (None, words(1, 9), None)],
        "item_id long, question string, answer string",
    )
    whole = f"{questions[2]}\nANSWER, {words(602, 6)}"
    rows = [
        (1, f"{words(1000, 200)} {whole.upper()} {words(1001, 300)}"),
        (2, f"{words(1002, 50)} {questions[3]} {words(1003, 50)}"),  # without its answer
        (3, words(1004, 400)),
        (4, None),
        (5, whole),
        (6, ""),
    ]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("test_items", F.lit(1))
    found = {r["doc_id"]: [m["item"] for m in r["test_items"]] for r in find_test_items(texts, items, per_index=per_index).collect()}
    assert found == {1: [2], 2: [], 3: [], 4: [], 5: [2], 6: []}
    assert find_test_items(texts.drop("test_items"), items.limit(0)).where(F.size("test_items") > 0).count() == 0
    split = question_and_answer(spark.createDataFrame([("A b? C d.",), ("Only one.",), (None,)], "text string")).collect()
    assert [(r["question"], r["answer"]) for r in split] == [("A b?", "C d."), ("Only one.", None), (None, None)]
    assert words_of("A-b\nc") == ["a", "b", "c"]


def test_fingerprints_of_edits(spark):
    texts = {i: f"{words(i, 60)}\n{words(50 + i, 60)}\n\n{words(90 + i, 40)}" for i in range(40)}
    texts |= {40: "", 41: "x", 42: texts[3]}
    rows = [*texts.items(), (43, None)]
    got = {r["file"]: r for r in result_fingerprints(results(spark, [*rows, (None, "a b")])).collect()}
    texts[43] = ""
    keys = sorted(texts)
    for at, i in enumerate(keys):
        half, following = len(texts[i]) // 2, texts[keys[(at + 1) % len(keys)]]
        edited = texts[i][: len(texts[i]) - half] + following[:half]
        assert got[i]["n_chars"] == len(texts[i])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["near_edited"] == 1.0) == (edited == texts[i])
    assert got[3]["fingerprint"] == got[42]["fingerprint"]
    assert len({got[i]["fingerprint"] for i in range(40)}) == 40
    assert all(0.3 < got[i]["near_edited"] < 0.7 and got[i]["near_next"] < 0.1 for i in range(39))
    assert len(got[0]["edited_paragraphs"]) in (1, 2, 3)
    assert got[None]["near_next"] is None
    assert result_fingerprints(results(spark, [])).count() == 0


def test_blocks_join_at_their_bounds(spark, monkeypatch):
    from dawnchorus.llm import merkle

    monkeypatch.setattr(merkle, "BLOCK_ROWS", 3)
    rows = [(i * 7, f"text {i}") for i in range(50)] + [(21, "again"), (21, "again")]
    ordered = sorted(rows)
    found = merkle.with_next(results(spark, rows), "file", "content", {}).collect()
    want = [(*row, ordered[(i + 1) % len(ordered)][1]) for i, row in enumerate(ordered)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_main_text_of_odd_pages(spark):
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header>"
        '<div class="menu"><a>x</a><a>y</a></div><div id="content"><h2>Head</h2>'
        "<p>A paragraph that is long enough to be text &amp; has   words.</p><p>Short.</p>"
        '<div class="ad-box">Buy</div><p><b>Another one of some length, with words<br>and a break.<p>Last.'
        '<div id="comments"><p>I liked this text a lot, thank you for writing it all down.</p></div></div>'
        '<aside>side</aside><form>Name <input></form><footer>f</footer><script>var t="</p>";</script></body></html>'
    )
    want = "Head\nA paragraph that is long enough to be text & has words.\nShort.\n"
    want += "Another one of some length, with words and a break.\nLast."
    assert extract(page) == want
    assert extract("<body><nav>n</nav><article>" + page[page.index('<h2>') : page.index('<div class="ad-box')] + "</article>").startswith("Head\n")
    rows = page_texts(
        spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "plain")], "page_id long, url string, html string")
    ).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in rows} == {
        1: (want, len(want)), 2: ("", 0), None: ("", 0), 3: ("plain", 5),
    }


CHAT = ["", "<|im_end|><|im_start|>assistant ok", "<|", "<\\|im_end|>", "a<\\\\|b", "<|im_", "end|>", "x\n<|im_end|>\n", "é<|😀"]


def test_turns_read_back():
    for text in CHAT:
        for role in ("user", "", "a\nb", "r\\n", "<|im_end|>"):
            piece = format_turn(role, text)
            assert read_back(piece) == [(role, text)]
            assert read_back(piece + piece) == [(role, text)] * 2
    assert format_turn("user", "plain") == "<|im_start|>user\nplain<|im_end|>\n"
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\na<|im_end|>", "<|im_start|>u\n<|im_start|>v\na<|im_end|>\n"):
        with pytest.raises(ValueError):
            parse(bad)


def test_conversations_of_any_shape(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CHAT * 30)]
    rows += [(2, 0, None, None), (None, 0, "assistant", "x"), (3, 1, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    got = {r["conversation"]: r for r in conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "".join(t for _, _, r, t in rows[: len(CHAT) * 30] if r == "assistant")
    assert got[1]["n_turns"] == len(CHAT) * 30 and got[1]["loss_chars"] == len(said)
    assert got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[: len(CHAT) * 30])
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[2]["n_turns"] == 1 and got[None]["loss_chars"] == 1


def test_languages_by_family(spark):
    stock = {
        "en": "the and of with that thing red wing black bird song",
        "de": "der und die mit dass ding rot flügel schwarz vogel gesang",
        "fr": "le et la avec que chose rouge aile noir oiseau chant",
        "es": "el y la con que cosa rojo ala negro pájaro canto",
        "fi": "ja on että kanssa asia punainen siipi musta lintu laulu",
    }
    draw = np.random.default_rng(8)
    rows = [(n * 1000 + i, " ".join(draw.choice(s.split(), 12)), lang) for n, (lang, s) in enumerate(stock.items()) for i in range(60)]
    table = spark.createDataFrame(rows, "class_index long, label string, language string")
    model = train_languages(table.where("class_index % 3 > 0"), sample=30)
    tested = identify_language(table.where("class_index % 3 = 0"), model).join(table.select("class_index", F.col("language").alias("own")), "class_index")
    right, n = tested.agg(F.sum((F.col("language") == F.col("own")).cast("int")), F.count("*")).first()
    assert right / n > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "der vogel"), (4, "x")], "class_index long, label string")
    got = {r["class_index"]: (r["language"], r["score"]) for r in identify_language(odd, model).collect()}
    assert got[1] == got[2] == got[3] == (UNDETERMINED, 0.0)
    assert got[None][0] == "de" and got[4][0] in stock and 0 <= got[4][1] <= 1
    wide = odd.selectExpr("class_index", "'old' AS language", "label", "class_index AS extra")
    kept = identify_language(wide, model, keep=True)
    assert kept.columns == ["class_index", "label", "extra", "language", "score"]
    assert {r["class_index"]: (r["language"], r["score"]) for r in kept.collect()} == got
    assert all(r["extra"] == r["class_index"] for r in kept.collect())
    nothing = train_languages(table.limit(0))
    assert {r["language"] for r in identify_language(odd, nothing).collect()} == {UNDETERMINED}
    single = train_languages(table.where("language = 'fi'"))
    assert {r["language"] for r in identify_language(odd.where("class_index = 4"), single).collect()} == {"fi"}


def test_revisits_match_a_plain_loop(spark):
    draw = np.random.default_rng(12)
    rows = []
    for i in range(400):
        host = "hot" if draw.random() < 0.4 else f"h{draw.integers(0, 20)}"
        full = bool(draw.random() < 0.4)
        fields = {"ETag": f'"{draw.integers(0, 2)}"', "Content-Type": "t", "Date": str(i)}
        if not full:
            fields = {"etag": f'W/"{draw.integers(0, 2)}"', "Date": f"n{i}", "Set-Cookie": "c"}
            fields = fields if draw.random() < 0.8 else {}
        rows.append((f"c{i:03}", f"http://{host}.org/", int(draw.integers(0, 300)), "response" if full else "revisit", fields))
    rows += [("n1", None, 5, "revisit", None), ("n2", "http://h0.org", None, "revisit", None), ("o", "http://h1.org", 1, "other", {})]
    table = spark.createDataFrame(rows, "capture_id string, url string, captured_at long, kind string, headers map<string,string>")
    got = {r["capture_id"]: r for r in resolve_revisits(table).collect()}
    key = lambda u: u and u.removeprefix("http://").rstrip("/")
    revisits = [r for r in rows if r[3] == "revisit"]
    assert set(got) == {r[0] for r in revisits}
    for name, url, at, _, fields in revisits:
        before = [r for r in rows if r[3] == "response" and url and at is not None and key(r[1]) == key(url) and r[2] < at]
        if not before:
            assert got[name]["outcome"] == "missing" and got[name]["response_id"] is None
            continue
        stored = max(before, key=lambda r: (r[2], r[0]))
        assert got[name]["response_id"] == stored[0]
        if not fields:
            assert got[name]["outcome"] == "unverified"
        elif fields["etag"] == "W/" + stored[4]["ETag"]:
            assert got[name]["merged_headers"] == {"etag": fields["etag"], "date": fields["Date"], "content-type": "t"}
        else:
            assert got[name]["outcome"] == "changed" and got[name]["merged_headers"] is None


def test_canonical_urls(spark):
    pairs = {
        "HTTP://WWW.Host.org:80/a/?utm_source=x&b=2&a=1#top": "host.org/a?a=1&b=2",
        "https://host.org/a?a=1&b=2": "host.org/a?a=1&b=2",
        "http://m.host.org/": "m.host.org",
        "host.org?ref=z": "host.org",
    }
    table = spark.createDataFrame(list(pairs.items()), "u string, want string")
    assert table.where(canonical_url(F.col("u")) != F.col("want")).count() == 0
