import random
import time

import pyarrow as pa
import pytest

from gneiss.llm import html_text, private
from gneiss.llm.decontaminate import contaminated
from gneiss.llm.html_text import extract_text, main_text
from gneiss.llm.private import base_spans, private_spans

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><a href="/x">Home</a></nav><!-- ad 1 --><div class="ad">Buy this</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text
 goes   on.<br><p>Second &lt;para&gt;<aside>no</aside><form><label>Name</label></form><p>x</p></article>
<section class="comments"><article><p>Reader says no</p></article></section><footer>&copy; no</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Head & line\n\nFirst bold text goes on.\n\nSecond <para>\n\nx"


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<nav>menu</nav>", ""), ("<article><p>cut of", "cut of"), ("<article><p>a &am", "a &am"), ("<article><p>t</p><scr", "t")])
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_without_article_long_lines_are_kept():
    body = "<div class='menu'><a>one</a></div><div><p>" + "long text here. " * 10 + "</p><p>short.</p></div><div class='sidebar'>x y z</div>"
    assert main_text(f"<body>{body}</body>") == ("long text here. " * 10).strip() + "\n\nshort."


ADVERT, LONG = "<div class='ad'>a</div>" * 3, "long text here. " * 10
LINKS = "<p><a href='/x'>one</a></p><p><a href='/y'>two</a></p><p><a href='/z'>three</a></p>"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body><p>Hello world.</p></body>", ["Hello world."]),
        (f"<p>Opening.</p>{ADVERT}<p>{LONG}</p>{ADVERT}<p>The end.</p>", ["Opening.", LONG.strip(), "The end."]),
        ("<article><p>Text</p><aside>ad</aside><p><a href='/s'>Source</a></p></article>", ["Text", "Source"]),
        (f"<article>{LINKS}<p>Text</p>{ADVERT}{LINKS}</article>", ["one", "two", "three", "Text", "one", "two", "three"]),
        ("<!-- <article> --><script>'<main>'</script><p>Text</p>", ["Text"]),
        ("<p>Text</p><div class='comments'><article>Reader</article></div>", ["Text"]),
        (f"{LINKS}<p>{LONG}</p>{ADVERT}{LINKS}", ["two", "three", LONG.strip()]),
        (LINKS, ["one", "two", "three"]),
    ],
)
def test_only_what_is_marked_as_other_is_dropped(page, want):
    assert main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_window_sums_are_those_of_each_window(window):
    rng = random.Random(window)
    for n in (0, 1, 2, 3, 40):
        weights = [rng.choice([0, 0, 5, 80]) for _ in range(n)]
        want = [sum(weights[i : i + window]) for i in range(n - window + 1)] or [sum(weights)]
        assert html_text.window_sums(weights, window).tolist() == want


def test_the_distribution_decides():
    """Where an article is a teaser text surges elsewhere; a menu is outweighed by text, unless no window could tell."""
    teaser = f"<article>More soon</article><div><p>{LONG}</p><p>short.</p></div>"
    assert main_text(teaser) == f"More soon\n\n{LONG.strip()}\n\nshort."
    assert main_text(f"<article><p>{LONG}</p></article><div><p>Imprint of the site</p></div>") == LONG.strip()
    unmarked = f"{LINKS}<p>{LONG}</p>"
    assert main_text(unmarked) == f"two\n\nthree\n\n{LONG.strip()}" and main_text(unmarked, window=100) == f"one\n\ntwo\n\nthree\n\n{LONG.strip()}"
    menu = "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(9))
    assert main_text(f"<ul>{menu}</ul><p>Tiny</p>").startswith("Section number 0") and not main_text(f"<ul>{menu}</ul><p>{LONG}</p>").startswith("Section number 0")


PROSE = [f"Paragraph {i} tells at some length what happened on the day, and why nobody at the time thought it worth writing down." for i in range(6)]
SHORT = [f"Imprint line {i}" for i in range(7)]


def blocks(texts, link=False):
    return "".join(f"<div><a href='/{i}'>{t}</a></div>" if link else f"<div>{t}</div>" for i, t in enumerate(texts))


@pytest.mark.parametrize(
    "page",
    [
        "{a}{b}{menu}", "{menu}{a}{b}", "{a}{menu}{b}", "{a}{b}{short}", "{short}{a}{b}", "{menu}{a}{short}{b}{menu}", "{short}{menu}{a}{b}{menu}{short}",
        "{a}<div class='reader-reactions'>" + PROSE[0] + "</div>{b}", "{a}<div class='ad-slot-large'>Buy</div>{b}", "{a}<div class='alert alert-info'>Cookie notice</div>{b}",
    ],
)
def test_surges_and_dives_choose_the_text_of_pages_without_marks(page):
    """Menus before, between and after text, footers, headers; and what classes name inside it."""
    menu = blocks([f"Section number {i}" for i in range(12)], link=True)
    html = page.format(a=blocks(PROSE[:3]), b=blocks(PROSE[3:]), menu=menu, short=blocks(SHORT))
    assert main_text(html) == "\n\n".join(PROSE)
    assert main_text(f"<article>{html}</article>").count("Paragraph") == 6
    if "menu" in page or "short" in page:  # without windows every line that isn't marked would stay
        assert len(main_text(html)) < len("\n\n".join(t for t, _, counts in html_text.lines(html) if counts))


def plain_choice(weights, window):
    """Surges, dives and what stays, line by line."""
    n = len(weights)
    windows = [range(s, s + window) for s in range(n - window + 1)] or [range(n)]
    sums = [sum(weights[i] for i in w) for w in windows]
    level = min(0.2 * max(sums), 150)
    holds = [i for i in range(n) if weights[i] * window >= level and any(i in w and x >= max(level, 1) for w, x in zip(windows, sums, strict=True))]
    kept = []
    for i in range(n):
        before, after = [k for k in holds if k < i], [k for k in holds if k > i]
        if i in holds:
            kept.append(True)
        elif not holds:
            kept.append(False)
        elif before and after:
            kept.append(after[0] - before[-1] - 1 < 6)
        elif after:
            kept.append(after[0] < 6 and after[0] - i < window)
        else:
            kept.append(n - 1 - before[-1] < 6 and any(weights[i:]))
    return kept


def test_the_choice_of_lines_line_by_line():
    rng = random.Random(4)
    for _ in range(3000):
        weights = [rng.choice([0, 0, 3, 20, 60, 90, 400]) for _ in range(rng.randrange(30))]
        for window in (1, 3, 5):
            if weights:
                assert html_text.text_lines(weights, window) == plain_choice(weights, window)
    assert html_text.text_lines([]) == [] and html_text.text_lines([0, 0, 0], marked=True) == [True] * 3


@pytest.mark.parametrize("name", ["related-work", "header-image", "share-price", "commentary", "advert-free"])
def test_names_that_only_contain_a_mark_are_kept(name):
    assert main_text(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a\n\nb"


@pytest.mark.parametrize("name", ["comments-list", "ad-banner", "site-header", "cookie_notice", "ad3", "main-nav", "x ad"])
def test_names_that_are_marks_are_dropped(name):
    assert main_text(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a"


def test_deep_and_long_pages_cost_what_they_are_long():
    began = time.time()
    assert main_text("<div>a" * 180_000).count("a") == 180_000 and time.time() - began < 20
    text = "word " * 400_000
    assert main_text(f"<article><p>{text}</article>") == text.strip()


def test_extract_text_frame(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in got] == [(1, True), (1, True), (2, True)] and got[2].text == ""
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html_text.lines("plain") == [("plain", 5, True)]


def test_detectors_follow_the_patterns():
    text = "a.b@c.d, 10.0.0.256 1.2.3.4, 4539 5787 6362 1486 +1 (988) 555-2485 @x 4539578763621487"
    assert base_spans(text) == [(0, "email", 7), (20, "ip", 27), (29, "card", 48), (49, "phone", 66)]
    assert base_spans("a@b.c@d.e") == [(0, "email", 5)] and base_spans("1.2.3.4.5.6.7.8") == [(0, "ip", 7), (8, "ip", 15)]
    assert base_spans("é +4912345678901") == [(2, "phone", 16)]


def test_model_adds_spans_and_keeps_base(spark):
    texts = [f"some words password=abc{i}def4567{i} and more, mail me.{i}@host{i}.org or +1 (30{i % 10}) 555-12{i % 10}4 here" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(98, None, ""), (99, "", ""), (100, "clean text in 1999 with nothing", "")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in private_spans(docs, private.learned(docs)).collect()}
    assert len(got) == 63 and got[98].spans == "" and got[98].masked is None and got[100].masked == "clean text in 1999 with nothing"
    for i, t in enumerate(texts):
        base = [f"{k}:{a}:{b}" for a, k, b in base_spans(t)]
        assert set(base) <= set(got[i].spans.split(",")) and got[i].n_email == 1 and got[i].n_phone == 1
    assert sum("secret" in got[i].spans for i in range(60)) > 50


def test_segments_of_the_best_labelling():
    weights = private.fit(["call +1 (300) 555-1234 now", "mail a.b@c.org now"] * 20)
    text = "then +1 (388) 555-9876 again"
    tokens = next(private.windows(text))
    found = [(text[tokens[i][0] : tokens[j - 1][1]], private.KINDS[k - 1]) for i, j, k in private.decode(text, tokens, weights)]
    assert found == [("+1 (388) 555-9876", "phone")]


def test_long_windows_are_decoded_in_parts(monkeypatch):
    weights = private.fit(["call +1 (300) 555-1234 now", "mail a.b@c.org now", "password=abc12345def here"] * 20)
    text = " ".join(["12 a.b@c.org 7 +1 (388) 555-9876", "3 password=xyz98765abc 4"][i % 2] for i in range(90))
    tokens = next(private.windows(text))
    assert len(tokens) > 300
    whole = private.decode(text, tokens, weights)
    assert len(whole) > 100 and [i for i, _, _ in whole] == sorted(i for i, _, _ in whole)
    for size in (1, 7, 1000):
        monkeypatch.setattr(private, "AT_ONCE", size)
        assert private.decode(text, tokens, weights) == whole


def test_templates_and_slots(spark):
    item = "So Mary buys 5 apples for 10 dollars and then Mary sells 2 apples to the farmer of the town"
    docs = [
        (1, "Well, Anna buys 7 apples for 12 dollars and then Anna sells 3 apples to the farmer of the town today"),
        (2, "Well, Anna buys 7 apples for 12 dollars and then Otto sells 3 apples to the farmer of the town today"),
        (3, None), (4, ""), (5, "nothing of this kind is in here, not even a number or a name"), (None, item),
    ]
    bench = spark.createDataFrame([(1, item), (2, None), (2, "short")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, None: False}
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0
    assert not contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).where("contaminated").count()


def test_short_items_verbatim_slots_and_other_runs(spark):
    long = "So Mary buys 5 apples for 10 dollars and then Mary sells 4 of them for 2 dollars to the old farmer and 1 to the town for 3 pounds"
    bench = [(1, "What is the capital of France"), (2, "Add 3 Anna 5 Otto 7 Emma 9 Paul 11 Nora 13 Hugo"), (3, long), (4, "Who knows")]
    docs = [
        (1, "A quiz had this one. What is the capital of France? Nobody knew, so we went on with the next of them"),
        (2, "A quiz had \"What is the capital of France\" in it, and nobody knew, so we went on with the next of them"),
        (3, "A quiz had this one. What is the capital city of France? Nobody knew."),
        (4, "Somebody wrote: add 3 Anna 5 Otto 7 Emma 9 Paul 11 Nora 13 Hugo and was done with it"),
        (5, "Somebody wrote: add 4 Anna 5 Otto 7 Emma 8 Paul 11 Nora 12 Hugo and was done with it"),
        # The second name contradicts the first: in one run, and in two that a changed word keeps apart.
        (6, "So Anna buys 7 apples for 12 dollars and then Otto sells 9 of them for 6 dollars to the old farmer and 8 to the town for 11 pounds"),
        (7, "So Anna buys 7 apples for 12 dollars and now Otto sells 9 of them for 6 dollars to the old farmer and 8 to the town for 11 pounds"),
        (8, "Who knows"), (9, "I ask who knows it"),
    ]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {r.doc_id for r in contaminated(docs, bench).where("contaminated").collect()} == {1, 2, 4, 7, 8}


def test_hashes_are_of_whole_words():
    from gneiss.llm.shared import hashed_words, text_bytes

    words, at = hashed_words(*text_bytes(pa.array(["Ab cd", None, "", "cd\tab é", " "])))
    assert at.tolist() == [0, 2, 2, 2, 5, 5] and words[0] == words[3] and words[1] == words[2] and len(set(words.tolist())) == 3
