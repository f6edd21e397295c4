"""HTML extraction keeps all of an article."""

from hitledger.llm.html_text import main_text

LONG = "This is a sentence, long enough to count; it has commas, too. " * 6
SHORT = "A short part, still of the article."
MENU = "<nav><a>Home</a><a>News</a></nav>"


def lines(page):
    return [x.strip() for x in main_text(page).split("\n")]


def test_inner_content_div_leaves_the_title():
    page = f"<body>{MENU}<article><header><h1>Title</h1></header><div class='entry'><p>{LONG}</p><p>{LONG}</p></div></article></body>"
    assert lines(page) == ["Title", LONG.strip(), LONG.strip()]


def test_sections_and_long_lists_leave_the_rest():
    page = f"<body>{MENU}<article><section><p>{SHORT}</p></section><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{SHORT}</p></section></article></body>"
    assert lines(page) == [SHORT, LONG.strip(), LONG.strip(), SHORT]
    items = "".join(f"<li>{LONG}</li>" for _ in range(5))
    assert lines(f"<main><p>{SHORT}</p><ul>{items}</ul></main>")[0] == SHORT
    assert lines(f"<body><div><h2>Head</h2><div><p>{LONG}</p><p>{LONG}</p></div></div></body>")[0] == "Head"


def test_class_words_of_a_wrapper_do_not_drop_the_page():
    for wrap in ("class='layout has-sidebar'", "id='page-with-nav'", "class='content social-post'", "class='search'"):
        page = f"<body><div {wrap}><article><h1>Title</h1><p>{LONG}</p></article><div class='sidebar'><p>{SHORT}</p></div></div></body>"
        assert lines(page) == ["Title", LONG.strip()], wrap
        assert lines(f"<body>{MENU}<div {wrap}><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{SHORT}</p></div></body>") == [LONG.strip()] * 2, wrap


def test_listed_words_beside_others_in_an_article():
    page = f"<article><p>{LONG}</p><section id='search-engines'><p>{LONG}</p></section><p class='related-work'>{LONG}</p><div class='share-buttons'>Send it</div></article>"
    assert lines(page) == [LONG.strip()] * 3


def test_long_comments_do_not_replace_a_short_article():
    page = f"<body><div class='layout'><article><p>{SHORT}</p></article><div class='comments'><p>{LONG}</p><p>{LONG}</p></div></div></body>"
    assert lines(page) == [SHORT]
    assert lines(f"<body><article><div class='content social-post'><p>{LONG}</p></div><p>{SHORT}</p></article></body>") == [LONG.strip(), SHORT]
