"""Density decides the region; elements and names only weigh."""

from __future__ import annotations

from dawnchorus.llm.main_text import extract

STORY = [f"{k} " + "some words of the story " * 8 for k in range(6)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in STORY)
TEASER = "another page has more " * 10
WANT = "\n".join(" ".join(t.split()) for t in STORY)


def test_an_article_of_little_text_is_not_the_region():
    page = f"<body><div id=story>{PARAGRAPHS}</div><article><p>{TEASER}</p></article></body>"
    assert extract(page) == WANT


def test_a_short_second_article_stays():
    page = f"<body><article>{PARAGRAPHS}</article><article><p>{STORY[0]}</p></article></body>"
    assert extract(page) == WANT + "\n" + WANT.split("\n")[0]


def test_a_furniture_name_does_not_discard_most_of_the_text():
    menu = "".join(f"<li><a>item {k}</a></li>" for k in range(5))
    inner = f'{PARAGRAPHS}<div class="menu">{menu}</div><div class="comments"><p>{STORY[0]}</p></div>'
    page = f'<body><ul class="nav">{menu}</ul><div class="has-sidebar">{inner}</div><p>By us</p></body>'
    assert extract(page) == WANT
    hidden = page.replace('<div class="has-sidebar">', '<div class="has-sidebar" hidden>')
    assert STORY[0].strip() not in extract(hidden)
