"""Scores do not depend on how the items are dealt over indexes."""

from __future__ import annotations

import random

from dawnchorus.llm.decontaminate import find_test_items


def test_parts_score_like_one_index(spark):
    draw = random.Random(9)
    names = [f"w{int(400 * draw.random() ** 3)}" for _ in range(4000)]
    items, texts = [], []
    for k in range(30):
        size = 60 if k == 7 else draw.randrange(12, 30)
        question, answer = draw.choices(names, k=size), draw.choices(names, k=draw.randrange(3, 8))
        items.append((k, " ".join(question), " ".join(answer)))
        for gap in (0, 25, 70):
            # Some words of the ends are missing, and question and answer may lie apart.
            held = question[draw.randrange(4) :]
            words = draw.choices(names, k=40) + held + [f"g{i}" for i in range(gap)] + answer
            texts.append((3 * k + gap // 30, " ".join(words + draw.choices(names, k=200))))
    items += [(90, "", None), (91, None, "...")]
    texts = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, question string, answer string")

    def found(per_index: int) -> dict[tuple[int, int], tuple]:
        rows = find_test_items(texts, items, threshold=0.8, per_index=per_index).collect()
        return {(r["doc_id"], m["item"]): tuple(round(x, 9) for x in m[1:]) for r in rows for m in r["test_items"]}

    whole = found(4096)
    assert len(whole) > 30 and any(m[0] < 0.99 for m in whole.values())
    assert found(10) == whole
