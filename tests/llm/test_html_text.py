import pytest

from framefusion.llm.html_text import extract_main_text, main_text

PAGES = [
    (None, ""),
    ("", ""),
    ("plain &lt;text&gt;  of\n a page", "plain <text> of a page"),
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav>"
     "<article><h1>Head</h1><p><b>One &amp; two&nbsp;three.<br><p>Short.</p><p>Four five six seven eight nine ten eleven.</p>"
     "</article><footer>&copy; us</footer></body></html>",
     "Head One & two three. Short. Four five six seven eight nine ten eleven."),
    ("<body><div class='menu'><a href=a>A</a></div><div id=content><h2>T</h2><p>short.<p>A long paragraph of text goes here and "
     "here, and more of it follows.</div><div class='comments'><p>first! a long comment by a reader with many words</p></div>"
     "<div class='site-footer'>c</div></body>", "T short. A long paragraph of text goes here and here, and more of it follows."),
    ("<main><p>Alpha beta gamma delta epsilon.</p><form><p>Name of the person who signs</p><input></form><aside>see also</aside>"
     "<div class='cookie-notice'>We use cookies</div><p>End", "Alpha beta gamma delta epsilon. End"),
    ("<div><p>unclosed <i>words <!-- note --> stay", "unclosed words stay"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


LONG = "A long sentence of the article that goes on with many plain words, and on. " * 12


@pytest.mark.parametrize("html,text", [
    (f"<body><div id=wrap><h1>Title</h1><p>A lead.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></div></body>", f"Title A lead. {LONG}{LONG}"),
    (f"<div>Intro here.<blockquote>{LONG}</blockquote></div>", f"Intro here. {LONG}"),
    (f"<div><p>Intro here.<section><p>{LONG}</section><p>Last words.</div>", f"Intro here. {LONG}Last words."),
    (f"<body><p>{LONG}<p><a href=x>The linked report</a><p>{LONG}<p>See <a href=y>the source</a>", f"{LONG}The linked report {LONG}See the source"),
    (f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><div>{LONG}</div></div><ul><li><a href=c>More</a></ul>", LONG)])
def test_pages_of_div_and_section_keep_the_whole_article(html, text):
    assert main_text(html) == text.strip()


def test_long_and_deep_pages():
    assert len(main_text("<article>" + "<p>some words here</p>" * 20_000).split()) == 60_000
    assert main_text("<div>" * 5_000 + "deep text" + "</div>" * 5_000) == "deep text"


def test_operator_keeps_every_row(spark):
    rows = [(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "clash"), (None, None, "<p>x", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_main_text(df, ["page_id", "url"]).collect()
    assert sorted((r.page_id is None, r.page_id, r.text, r.n_chars) for r in out) == sorted(
        (i is None, i, t, len(t)) for i, t in [*enumerate(t for _, t in PAGES), (0, ""), (None, "x")])
    assert extract_main_text(df.limit(0), ["page_id", "url"]).count() == 0
