"""Pages that leave out tags, sit in named wrappers, or have no article."""

import random
import time

import pytest

from tallyweave.llm.html_extract import main_text

WORDS = "these are many plain words of the main text and they go on for a while "
BODY = f"<p>{WORDS * 3}one.</p><p>{WORDS * 3}two.</p>"
TEXT = f"{WORDS * 3}one. {WORDS * 3}two."


@pytest.mark.parametrize("start", ["<html><head><title>T</title><body>", "<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><style>p{}</style><link rel=x><div>"])
def test_head_end_tag_may_be_left_out(start):
    assert main_text(f"{start}<article>{BODY}</article>") == TEXT


def test_head_without_end_tag_before_text():
    assert main_text("<head><title>T</title>Just text.") == "Just text."
    assert main_text("<head><template><p>never</p></template><noscript><p>No script</p></noscript></head>") == "No script"


@pytest.mark.parametrize("name", ["page has-sidebar", "content widget", "page no-sidebar", "layout-sidebar"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrapper_names_leave_the_article(name, tag):
    comments = f'<div id="comments"><article>{WORDS * 20}</article></div>'
    for page in (f'<div class="{name}"><{tag}>{BODY}</{tag}></div>', f'<div class="{name}"><nav>Menu</nav><{tag}>{BODY}<div class="ad">Buy</div></{tag}>{comments}</div><footer>us</footer>', f'<main><h1>T</h1><div class="{name}"><article>{BODY}</article></div></main>'):
        assert main_text(page).removeprefix("T ") == TEXT


def test_named_places_stay_boilerplate():
    comments = "".join(f'<article class="comment">{WORDS * 5}</article>' for _ in range(9))
    for rest in (f'<div id="comments">{comments}</div>', f'<aside><article>{WORDS * 20}</article></aside>', f'<div role="banner"><main>{WORDS * 20}</main></div>'):
        assert main_text(f"<article>{BODY}</article>{rest}") == TEXT
    assert main_text("<div class=cookie-notice>We use cookies.</div>") == ""


def test_short_first_and_last_lines_without_article():
    page = f"<body><nav>Menu</nav><div><h2>On boats</h2>{BODY}<p>The end.</p></div><div>Other</div><footer>us</footer>"
    assert main_text(page) == f"On boats {TEXT} The end."
    assert main_text(f"<div><h2>On <i>boats</i></h2>{BODY}<p>The end.</p><aside>Ad</aside><p>More</p></div>").startswith("On boats")


def test_malformed_pages_never_fail():
    odd = {"<p>a</p><![foo[x]]>": "a", "<p>é</p><![CDATA[ y": "é", "<p>q</p><!doctype": "q", "<!-- x": "", "<p>a</p><!>b": "a b", "<![if !IE]><p>c</p><![endif]>": "c"}
    assert {h: main_text(h) for h in odd} == odd
    rng = random.Random(9)
    bits = ["<p>", "</p>", "<![", "<!", "<!--", "-->", "]]>", "<", ">", "&", "&#", "&#x110000;", ";", "<a href='", "'", '"', "<script>", "</script>", "<b", "</", "<?", "/>", "text", " ", "\x00", "é", "<svg>", "<head>", "<template>", "</i>", "<article class=menu>", "<plaintext>", "<![CDATA["]
    for _ in range(3000):
        assert isinstance(main_text("".join(rng.choice(bits) for _ in range(rng.randrange(30)))), str)


def test_events_take_constant_time():
    def seconds(n):
        began = time.perf_counter()
        for page in ("<b>" * n + "</i>" * n, "<head><template>" + "<b>" * n, "<a>" * n + "<p>x" * n + "</a>" * n):
            main_text(page)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(40_000) < 40 * seconds(4_000)


def test_clusters_decide_where_names_say_nothing():
    links = "".join(f'<li><a href="/{i}">Some other page {i}</a></li>' for i in range(6))
    for before, after in ((f'<div class="zq1"><ul>{links}</ul></div>', ""), ("", f'<div class="zq2"><ul>{links}</ul></div>'), ("<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>", f"<ul>{links}</ul>")):
        assert main_text(f"<body>{before}<div>{BODY}</div>{after}</body>") == TEXT
        assert main_text(f"<article>{BODY.replace('</p>', f'</p><ul>{links}</ul>', 1)}</article>") == TEXT  # inside the region
    assert main_text(f'<div class="menu">{links}</div><div class="widget">{BODY}</div>'.replace("<li>", "<p>")) == TEXT  # a name that the clusters outvote
    assert main_text(f"<ul>{links}</ul>") != ""  # nothing but links: better than nothing
