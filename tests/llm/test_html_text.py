import time

import pytest
from pyspark.sql import functions as F

from prosegauge.llm import html_text as H
from prosegauge.llm.html_text import extract, main_text

P1 = "This is the first paragraph of the article, and it has enough of the usual words to be seen as text by the rules that look at it."
P2 = "A second one follows, which is about as long as the first, and it too is made of the words that one would expect in a text &amp; more."
PAGE = f"""<!DOCTYPE html><html><head><meta charset=utf-8><title>No title</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a> The site of the town</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- ad --><div class="ad">Buy the best of the best in the town and be the first to have it now.</div>
<div class="cookie-notice">We use cookies to be of use to you and to all of the people who are here with us.</div>
<article><h1>Big news</h1><p>{P1}<br><p>{P2}</p><ul><li>A short point</li><li>Another</ul>
<aside>Read this other text of the day, which is not a part of the article at all.</aside><p>It ends&nbsp;here,   with <b>bo</b>ld
 words.</p><section id="comments"><p>I am a reader and I think that this is the best of all the texts that I have read here in years.</p></section></article>
<form><p>Sign up for the letter of the week, it is free and it is good for you and for all.</p><input></form><footer>&copy; The town and the people of it</footer></body></html>"""


def test_article():
    assert main_text(PAGE).split("\n\n") == ["Big news", P1, P2.replace("&amp;", "&"), "A short point", "Another", "It ends here, with bold words."]


def test_rules_without_article():
    page = f"<body><div id=menu>{'<a href=x>go there</a> ' * 9}</div><div><h2>Head</h2><p>{P1} {P2}</p><p>Short one.</p><p>{P2} {P1}</p></div><div>{'<a href=x>more of this</a> ' * 9}</div><p>Contact"
    assert [t[:5] for t in main_text(page).split("\n\n")] == ["Head", "This ", "Short", "A sec"]


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a <!-- never closed", "a"), ("<script>x", ""), ("a < b <3", "a < b <3"), ("<div><p>one<p>two", "one\n\ntwo")])
def test_edges(html, text):
    assert main_text(html) == text


STORY = f"<h2>Head of it</h2><p>{P1} {P2}</p><p>Short one.</p><p>{P2} {P1}</p>"
TOLD = ["Head of it", f"{P1} {P2}".replace("&amp;", "&"), "Short one.", f"{P2} {P1}".replace("&amp;", "&")]
MENU = "<div class=menu>" + "<a href=x>go there</a> " * 9 + "</div>"
THREAD = "".join(f"<div class=comment><p>I am reader {i}, and I think that this is the best of all the texts that I have read here, and I have been here for years and years.</p></div>" for i in range(3))


@pytest.mark.parametrize(
    "around",
    [
        "<div class='container has-sidebar'>{}</div>",
        "<div class='layout with-comments'>{}</div>",
        "<section class='related-work'>{}</section>",
        "<div class='legal-text'>{}</div>",
        "<form id=aspnetForm><div id=menu>{}</div></form>",
        "<div class=sidebar>{}</div>",
        "<main><div data-id='ad'>{}</div></main>",
        "{}<article class=card><h3><a href=x>Next</a></h3><p>Read on here.</p></article><article class=card><p>And there, in short.</p></article>",
    ],
)
def test_wrappers_and_teasers(around):
    """Names of wrappers and cards beside the story do not cost the story."""
    got = main_text(f"<body>{MENU}{around.format(STORY)}<footer>&copy; The town</footer></body>").split("\n\n")
    assert [t for t in TOLD if t in got] == TOLD and len(got) <= len(TOLD) + 2


def test_comments_stay_out():
    for around in ("{}", "<article>{}</article>", "<div class='page'>{}</div>"):
        for thread in (f"<div id=comments>{THREAD}</div>", f"<ul class='comment-list'>{THREAD}</ul>", f"<section class='post-comments'>{THREAD}</section>"):
            assert main_text(f"<body>{MENU}{around.format(STORY)}{thread}</body>").split("\n\n") == TOLD


ZH = "今天早上，城市的居民在公园里看到了一件奇怪的事情。很多人停下来拍照，有人说他们从来没有见过这样的景象。"
PL = "Wczoraj rano mieszkańcy miasta zobaczyli coś dziwnego w parku, a wielu z nich zatrzymało się na chwilę. Nikt nie wiedział, co to jest, ale wszyscy robili zdjęcia i rozmawiali o tym przez cały dzień."
FI = "Eilen aamulla kaupungin asukkaat näkivät puistossa jotakin outoa, ja moni heistä pysähtyi hetkeksi. Kukaan ei tiennyt, mistä oli kyse, mutta kaikki ottivat kuvia ja puhuivat siitä koko päivän."


@pytest.mark.parametrize("text", [ZH, PL, FI])
def test_other_languages(text):
    page = f"<body>{MENU}<div class=page><p>{text}</p><p>{text[:12]}</p><p>{text}{text}</p></div><div class=footer>{text[:20]}</div></body>"
    assert main_text(page).split("\n\n") == [text, text[:12].strip(), text + text]


SPECS = "Weight: 3 kg. Colour: red, green, blue. Size: large, medium, small. Material: steel, copper, oak. Voltage: 230, 110. Origin: Leeds, Turin, Lyon. Batteries: two, AA. Cable: 2 m. Warranty: none, sorry."


def test_each_rule_decides(monkeypatch):
    """Without stop words, links, length or neighbours the answer is another one."""
    links = " ".join(f"<a href=x>{P1[i : i + 9]}</a>" for i in range(0, 90, 9))
    page = f"<body><div><p>{SPECS}</p></div><div><p>{P1} {P2}</p><p>Short one.</p><p>{P2} {P1}</p></div><div><p>{links} of the and to</p></div></body>"
    whole = main_text(page)
    assert whole.split("\n\n") == TOLD[1:]
    for name, value in (("STOP_WORDS", frozenset()), ("LINKS_BAD", 2.0), ("_inherit", lambda *_: "bad"), ("SHORT", 10**6)):
        with monkeypatch.context() as m:
            m.setattr(H, name, value)
            assert main_text(page) != whole, name


def test_neighbours_and_ties():
    """Between two labels: the one of the same element, else the nearer, a tie to the one above; a heading looks down."""
    good, bad, between = (H.Block("x", 0.0, False, False, h, label=label) for h, label in ((1, "good"), (2, "bad"), (3, "ambiguous")))
    assert H._inherit([good, between, bad], 1, 0, 2) == "good" and H._inherit([bad, between, good], 1, 0, 2) == "bad"
    assert H._inherit([bad, between, between, good], 2, 0, 3) == "good"
    between.holder = 1
    assert H._inherit([bad, between, good], 1, 0, 2) == "good"
    between.holder, between.heading = 3, True
    assert H._inherit([good, between, bad], 1, 0, 2) == "bad"
    assert H._inherit([good, between], 1, 0, None) == "good" and H._inherit([between, bad], 0, None, 1) == "bad"


def test_long_and_hostile():
    assert len(main_text("<article>" + f"<p>{P1}</p>" * 5000)) == 5000 * len(P1) + 2 * 4999
    main_text('<a href="' * 3000)
    main_text("<div " * 20_000)
    assert len(H.scan("<b>" * 2000 + "x").blocks) == 1


@pytest.mark.parametrize("unit", ["<b>x y ", "<a href=x>x y ", "<div>x y ", "<p>x y ", "<div class=ad>x ", "<span hidden>x ", "<h2>x </div>", "</section><i>x ", "<li>x ", "<td>x "])
def test_linear_in_the_page(unit):
    """Unclosed elements: three times the page takes about three times as long."""

    def took(n):
        began = time.process_time()
        main_text(unit * n)
        return time.process_time() - began

    assert took(30_000) < 6 * max(took(10_000), 0.05)


def test_frame(spark):
    df = spark.createDataFrame([(1, None), (2, PAGE), (2, PAGE)], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = df.select("page_id", extract(F.col("html")).alias("t")).collect()
    assert [r.t for r in sorted(got, key=lambda r: r.page_id)] == ["", main_text(PAGE), main_text(PAGE)]
    assert df.limit(0).select(extract(F.col("html"))).count() == 0
