"""Main text of pages whose names, languages or markup mislead, and the second pass against a plain form of its rule."""

from __future__ import annotations

import random
import time

import pytest

from spoolsight.llm.block_html import main_text, second_pass

TEXT = "It was the best of the times and it was the worst of the times, as it is said in the book that we all have. " * 2
AROUND = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{}<div class='comments'><p>{}</p></div><footer>The end of it</footer></body></html>"


@pytest.mark.parametrize(
    "around",
    [
        '<div class="content has-sidebar"><article>{}</article></div>', '<main class="no-sidebar">{}</main>', '<article class="post comment-open">{}</article>', '<article class="post tags-none x">{}</article>',
        '<article class="tag-search">{}</article>', '<section class="related-work">{}</section>', '<div id="main-menu-open">{}</div>', '<form id="page"><div>{}</div></form>', '<main id="search-result">{}</main>', "<div class='layout has-sidebar'>{}</div>",
    ],
)
def test_names_do_not_lose_the_article(around):
    page = around.format(f"<p>{TEXT}</p><p>Short.</p>")
    want = f"{TEXT.strip()}\nShort."
    assert main_text(page) == want
    assert main_text(AROUND.format(page, TEXT.replace("best", "comment"))) == want


def test_comments_longer_than_the_article():
    comments = f"<section class='comment-list'>{f'<article class=comment><p>{TEXT}</p></article>' * 60}</section>"
    assert main_text(f"<main><article><p>{TEXT}</p></article>{comments}</main>") == TEXT.strip()
    assert main_text(f"<div class='entry'><p>{TEXT}</p></div>{comments}") == TEXT.strip()
    assert main_text(f"<main><p>{TEXT}</p><aside><p>{TEXT * 5}</p></aside></main>") == TEXT.strip()


def test_article_without_known_stop_words():
    words = "Xyzzy qwert plugh frobnicate gribble snarf " * 8
    page = f"<article><p>{words}</p><table><tr><td>One cell</td><td>2</td></tr></table><p><a href=x>link one</a></p><p><a href=y>link two</a></p></article>"
    assert main_text(page) == f"{words.strip()}\nOne cell\n2"


@pytest.mark.parametrize(
    "long, short",
    [
        ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura!", "Tant'è amara."),
        ("Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских. Жена узнала, что муж был в связи с бывшею в их доме гувернанткой, и объявила мужу, что не может жить с ним.", "Да."),
        ("吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。吾輩はここで始めて人間というものを見た。", "終わり。"),
    ],
)
def test_languages_without_stop_words(long, short):
    page = f"<html><body><div><a href=1>Menu</a></div><div><p>{long}</p><p>{short}</p></div><div><a href=2>One</a> <a href=3>Two</a></div></body></html>"
    assert main_text(page) == f"{long}\n{short}"


def test_unclosed_markup_and_time():
    assert [main_text(p) for p in ("<script>x", "a<!-- x > y", "a<!-- x", "a<!-->b", "<script>a</script>b", "1<2 and 3>2 so")] == ["", "a", "a", "ab", "b", "1<2 and 3>2 so"]
    began = time.time()
    for page in ("<ul>" * 8000 + "</div>" * 8000 + "<div class=ad>" * 8000 + "x", "<a " * 20_000, "<p '" * 20_000 + ">", "<b>" * 50_000):
        main_text(page)
    assert time.time() - began < 5


def plain_second_pass(labels, sections, articles):
    """The rule, block by block, over all pairs of blocks."""
    out = []
    for k, label in enumerate(labels):
        if label is None:
            decided = [j for j in range(len(labels)) if labels[j] is not None and sections[j] is not None]
            own = [j for j in decided if sections[j] == sections[k]]
            if articles[k]:
                before, after = [j for j in own if j < k][-1:], [j for j in own if j > k][:1]
                label = any(labels[j] for j in before + after) or not any(labels[j] for j in own)
            elif own or decided:
                near = own or decided
                least = min(abs(j - k) for j in near)
                said = {labels[j] for j in near if abs(j - k) == least}
                label = bool(own) if len(said) == 2 else said.pop()
            else:
                label = True
        out.append(label)
    return out


def test_second_pass_equals_plain_form():
    rnd = random.Random(9)
    for _ in range(2000):
        n = rnd.randint(0, 12)
        sections = [rnd.choice([None, 0, 1, 2]) for _ in range(n)]
        labels = [False if s is None else rnd.choice([True, False, None, None]) for s in sections]
        articles = [s == 1 for s in sections]
        assert second_pass(labels, sections, articles) == plain_second_pass(labels, sections, articles)


TEXT = "The river runs down from the hills and through the old town, and in the spring it is so high that the bridge has to be closed for some days."


@pytest.mark.parametrize("tail", ["<script>document.write('<b>x</b>'); trackUser()", "<!-- a </b> secret tail", "<!-- a </script> secret", "<style>p > b {} </b> x", "<script>a </style> b", "<textarea>x</p> y", "<!--x</b>>y", "<SCRIPT>1 </b> 2"])
def test_what_is_left_open_is_no_text(tail):
    assert main_text(f"<body><article><p>{TEXT}</p></article>{tail}") == TEXT


@pytest.mark.parametrize("tail", ["<script>a</script >", "<!-- a -->", "<!-- a --!>", "<!-->", "<!--->", "<STYLE>b</style>"])
def test_what_is_closed_by_its_own_end_hides_nothing_after_it(tail):
    assert main_text(f"<body><article><p>{TEXT}</p>{tail} and so on") == f"{TEXT}\nand so on"


def test_a_link_alone_among_an_article_stays_and_lists_of_links_go():
    page = "<article><p>{0}</p><p><a href=x>the report of the commission on the bridge</a></p><p>{0} Again.</p></article>"
    assert main_text(page.format(TEXT)).split("\n") == [TEXT, "the report of the commission on the bridge", TEXT + " Again."]
    listed = f"<article><p>{TEXT}</p><ul><li><a href=a>One of the other reports</a></li><li><a href=b>Another one of the reports</a></li></ul></article>"
    assert main_text(listed) == TEXT


@pytest.mark.parametrize("line", ["<div class=copyright>2024 The Town Council and its friends</div>", "<div>© 2024 The Town Council</div>", "<p>Copyright 2024, the town.</p>", "<div>The Town Council 2024. All rights reserved.</div>", "<div class=legal>Terms of the town</div>"])
def test_lines_of_the_owner_go(line):
    assert main_text(f"<body><article><p>{TEXT}</p></article>{line}</body>") == TEXT
