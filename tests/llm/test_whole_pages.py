"""Pages whose main text must come out whole."""

import pytest

from trackmill.llm import wrappers


def texts(*pages):
    """What the operator does for one host, without Spark."""
    whole = None
    for page in pages:
        one = wrappers.loads(wrappers.dumps(wrappers.shape(wrappers.parse(page))))
        whole = one if whole is None else wrappers.merge(whole, one)
    decided = wrappers.decide(whole)
    return [wrappers.text_of(page, decided) for page in pages]


MENU = "<div><a>Home</a></div><div><a>News</a></div>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body>{MENU}<h1>T</h1><div>long text</div></body>", "T long text"),
        (f"<body>{MENU}<h1>T</h1><div><article>long text</article></div></body>", "long text"),
        ("<body><p><a>x</a></p><p><a>y</a></p><h1>T</h1><p>text</p></body>", "T text"),
        ("<body><p><a></a></p><p><a></a></p><h1>T</h1><p>text</p></body>", "T text"),
        ("<body><div></div><div></div><h1>T</h1><div>text</div></body>", "T text"),
        (f"<body>{MENU}<div>text</div></body>", "Home News text"),
        (f"<body><h1>T</h1><div><a>only link</a></div><hr>{MENU}</body>", "T only link"),
        (f"<body><main>{MENU}</main></body>", "Home News"),
    ],
)
def test_menu_is_dropped_at_its_place_only(page, text):
    assert texts(page) == [text]


def test_menu_of_a_host_leaves_pages_without_it():
    menu, without = f"<body>{MENU}<h1>T</h1><div>one</div></body>", "<body><h1>U</h1><div>two</div></body>"
    assert texts(menu, without) == ["T one", "U two"] and texts(without, menu) == ["U two", "T one"]
    assert texts(menu, "<body><div>three</div></body>")[1] == "three"


@pytest.mark.parametrize(
    "page,text",
    [
        ('<body class="has-sidebar"><p>text</p><div class="sidebar-left">no</div></body>', "text"),
        ('<body class="no-comments sidebar"><p>text</p></body>', "text"),
        ('<body><h1>T</h1><div class="content with-sidebar"><p>text</p></div></body>', "text"),
        ('<body><div class="content comments-open">text</div><div class="post-comments">no</div></body>', "text"),
        ('<body><article class="post category-social">text<div class="social">no</div></article></body>', "text"),
        ('<body><article class="social">text</article></body>', "text"),
        ('<body><div class="widget"><article>text</article></div></body>', "text"),
        ('<body><div class="related"><article>no</article></div><article>text</article></body>', "text"),
        ('<body><h1>T</h1><div class="widget">all of the text</div><div class="left-sidebar">no</div></body>', "T all of the text"),
        ('<body><article>text<section id="comments">a long thread of comments</section></article></body>', "text"),
        ('<body><div class="ad">one</div><div class="notice">two</div></body>', "one two"),
    ],
)
def test_names_drop_no_main_text(page, text):
    assert texts(page) == [text]


@pytest.mark.parametrize("tag", ["video-player", "title-bar", "select-menu", "svg-icon"])
def test_custom_elements_are_no_raw_elements(tag):
    assert texts(f"<body><{tag}>one</{tag}><p>two</p></body>") == ["one two"]


@pytest.mark.parametrize("empty", ["<svg/>", '<svg viewBox="0 0 1 1" />', "<math />", "<svg><title>no</title></svg>", "<script>no</script >"])
def test_text_after_raw_elements_stays(empty):
    assert texts(f"<body><p>one</p>{empty}<p>two</p></body>") == ["one two"]


@pytest.mark.parametrize("depth", [150, 250, 20_000])
def test_deep_pages(depth):
    page = "<body><article>" + "<div>" * depth + "<p>in</p><aside>no</aside>" + "</div>" * depth + "<p>out</p></article><p>no</p></body>"
    assert texts(page, page.replace("in", "im")) == ["in out", "im out"]
    assert wrappers.expression(wrappers.shape(wrappers.parse(page))).count("<div>") == depth
