"""Differencing decides pages whose markup or nearest neighbour misleads."""

from tablewright.llm import html

MENU = "".join(f"<div>Menu entry number {i} of the whole site</div>" for i in range(12))


def text(page, *others):
    return html.main_text(html.page_lines(page), *(html.page_lines(x) for x in others))


def short(words):
    return f"<body>{MENU}<div>{words}</div></body>"


def test_short_articles_lose_the_template():
    assert text(short("A short story about rivers."), short("Other news from town today."), short("Third piece on trains.")) == "A short story about rivers."
    assert text(short("A short story about rivers."), short("Other news from town today.")) == "A short story about rivers."


def test_copies_are_passed_over():
    page = short("A short story about rivers.")
    assert text(page, page, short("Other news from town today.")) == "A short story about rivers."
    assert text(page, short("A short story about rivers, updated."), short("Other news from town today.")) == "A short story about rivers."
    assert "rivers" in text(page, page) and "Menu entry number 1 " in text(page, page)


def test_the_same_text_beside_other_links_stays():
    story = "".join(f"<div>Sentence {i} of a long story that two sites carry.</div>" for i in range(20))
    one, two = (f"<body><div>Home</div>{story}<div>{link}</div></body>" for link in ("Read about cats", "More on ships"))
    got = text(one, two, "<body><div>Home</div><div>Entirely different words here</div></body>")
    assert "Sentence 19" in got and "Home" not in got


def test_teaser_cards_do_not_hide_the_main_text():
    cards = "<article>Read next: lakes</article><article>Read next: hills</article>"
    page, other = (f"<body><div>Site name</div>{''.join(f'<div>{t}{i} is {t}{i + 50} line.</div>' for i in range(9))}{cards}</body>" for t in ("River", "Train"))
    assert text(page, other) == "\n".join(f"River{i} is River{i + 50} line." for i in range(9))


def test_declared_lines_that_neighbours_repeat_stay():
    page = "<body><div>Menu</div><article><p>All rights are free.</p><p>{}</p></article></body>"
    assert text(page.format("first own words"), page.format("second other text")) == "All rights are free.\nfirst own words"
