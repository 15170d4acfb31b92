"""The main text of pages in which containers' tags and classes mislead."""

import pytest

from scenemill.llm import html_text

PARTS = [f"{' '.join(f'w{k}x{i}' for i in range(n))}" for k, n in enumerate((60, 27, 75, 90))]
BODY = "".join(f"<p>{p}</p>" for p in PARTS)
LINKS = "<ul>" + "<li><a href='/x'>one more link</a></li>" * 6 + "</ul>"
ADVERT = "buy this very good thing now"


@pytest.fixture(scope="module")
def text_of(spark):
    def found(pages):
        rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
        return [r.text for r in sorted(html_text.main_text(rows).collect())]

    return found


def test_articles_in_wrappers_that_sound_like_something_else(text_of):
    wrapped = [
        f"<body><nav>{LINKS}</nav><div class='has-sidebar'>{BODY}<div class='sidebar'>{LINKS}<p>{'aside ' * 24}</p></div></div><footer>Copyright</footer></body>",
        f"<body>{LINKS}<div class='widget-wrap'><div class='content'>{BODY}</div></div></body>",
        f"<body><form>{LINKS}<div>{BODY}</div></form></body>",
    ]
    assert text_of(wrapped) == ["\n".join(PARTS)] * len(wrapped)


def test_links_and_adverts_in_articles_are_left_out(text_of):
    inside = [
        f"<article>{BODY}{LINKS}</article>",
        f"<article>{BODY}<p class='advert'>{ADVERT}</p></article>",
        f"<article><p class='ad'>{ADVERT}</p>{BODY}<ul><li class='sponsored'><p>{ADVERT}</p></li></ul></article>",
    ]
    assert text_of(inside) == ["\n".join(PARTS)] * len(inside)


def test_sidebars_and_comments_stay_out_of_pages_without_an_article(text_of):
    page = f"<body><div>{BODY}</div><div class='sidebar'><div class='content'><p>{'aside ' * 30}</p></div></div><div class='comments'>{BODY * 3}</div></body>"
    assert text_of([page, f"<body><div class='comments'>{BODY}</div></body>"]) == ["\n".join(PARTS), ""]


def test_hidden_elements_without_an_end_hide_no_article(text_of):
    menus = [f"<nav><{tag}>Menu <ul><li>Home</li></ul>" for tag in ("button", "select", "noscript", "svg", "object")]
    pages = [f"<body>{m}</nav><article>{BODY}</article></body>" for m in menus] + [f"<body>{m}<article>{BODY}</article><button>Go</button></body>" for m in menus]
    pages += [f"<body><div><button>Menu</div><div>{BODY}</div></body>", f"<body><button>Menu{BODY}</body>"]
    assert text_of(pages) == ["\n".join(PARTS)] * len(pages)


def test_hidden_elements_with_an_end_stay_hidden(text_of):
    shut = [f"<{tag}><div><p>{'not shown ' * 30}</p></div><object><p>{'nor this ' * 30}</p></object></{tag}>" for tag in ("noscript", "template", "object", "video", "button")]
    assert text_of([f"<article>{BODY}{s}</article>" for s in shut]) == ["\n".join(PARTS)] * len(shut)


def test_formulas_are_text(text_of):
    formula = "<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x \\eq 1</annotation></semantics></math>"
    assert text_of([f"<article><p>where {formula} holds</p>{BODY}</article>"]) == ["\n".join(["where x=1 holds", *PARTS])]


def test_long_and_stray_quotes_in_tags(text_of):
    tags = [f"<div data-x='{'a > b ' * 3000}'>", f'<div data-x = "{"<p> it\'s " * 3000}" class=x>', "<div title=it's data-y=a\"b>", "<div 'x>", "<div x=''>", "<div/x=1 y>", "<div data-x='>"]
    assert text_of([f"<article>{t}{BODY}</div></article>" for t in tags]) == ["\n".join(PARTS)] * len(tags)
