import pytest

from venuelake.llm import html_text, language_id

PAGE = (
    '<!DOCTYPE html><html lang="{lang}"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
    '<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>{text}<br><p>Second   paragraph\nof the text.</article><div class="comments"><p>A reader says so.</p></div>'
    '<form><label>Mail</label><input></form><footer>Imprint</footer></body></html>'
)


def test_the_article_is_kept_and_the_rest_left_out():
    got = html_text.main_text(PAGE.format(lang="en", text="First paragraph with a few words."))
    assert got == "Head & line First paragraph with a few words. Second paragraph of the text."


def test_pages_of_every_kind_are_defined(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a>only a menu</a></nav>"), (4, "u", "plain words alone"), (5, "u", "<p>broken <b"), (6, "u", "<p>" + "word " * 30_000), (4, "u", "plain words alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()]
    assert [g[:2] for g in got[:3]] == [(1, ""), (2, ""), (3, "")]
    assert got[3] == got[6] == (4, "plain words alone", 17)
    assert got[4][1] == "broken" and got[5][2] == 5 * 30_000 - 1
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_short_runs_inside_an_article_that_is_not_marked_are_kept():
    long = lambda n: [f"<p>{'word ' * (n // 5 - 1)}last" for _ in range(6)]
    items = [f"item number {i:02d} of list" for i in range(12)]
    speech = [f"he said {i:02d} and she said no" for i in range(10)]
    flows = [
        [*long(400), "<ul>", *(f"<li>{i}</li>" for i in items), "</ul>", *long(400)],
        [*long(400), "<ul>", *(f'<li><a href="/x">{i}</a></li>' for i in items), "</ul>", *long(400)],
        [*long(600), "<div class=say>", *(f"<div>{i}</div>" for i in speech), "</div>", *long(600)],
        [f"<div>{p}</p></div>" for p in long(600)] + [f"<div>{i}</div>" for i in speech] + [f"<div>{p}</p></div>" for p in long(600)],
        [*long(400), "<table>", *(f"<tr><td>{i}</td></tr>" for i in items), "</table>"],
    ]
    menu = "<div>" + "".join(f'<div><a href="/{i}">Section {i}</a></div>' for i in range(15)) + "</div>"
    for flow in flows:
        body = "".join(flow)
        want = " ".join(html_text.text_lines(body)[k][0] for k in range(len(html_text.text_lines(body))) if html_text.text_lines(body)[k][0])
        assert all(i in want for i in items) or all(i in want for i in speech)
        assert html_text.main_text(f"<html><body><div id=wrap><div class=body>{body}</div></div></body></html>") == want
        got = html_text.main_text(f"<html><body><div id=wrap>{menu}<div class=body>{body}</div>{menu}</div></body></html>")
        assert want in got and got.count("Section 7") == 0


def _page(*blocks):
    return "<html><body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body></html>"


def brute_flat(html, sigma, threshold):
    """Pages of plain paragraphs: all from the first to the last line above the threshold."""
    import math

    lines = [(t, len(t) / max(n, 1)) for t, n, *_ in html_text.text_lines(html)]
    ratios = [r for _, r in lines]
    reach = math.ceil(3 * sigma)
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-(((j - i) / sigma) ** 2) / 2), ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    used = [r for t, r in lines if t]
    cut = min(threshold * spread, html_text.MEAN_SHARE * sum(used) / len(used))
    over = [i for i, (t, _) in enumerate(lines) if t and smooth[i] >= cut]
    return " ".join(t for t, _ in lines[over[0] : over[-1] + 1] if t)


def test_unmarked_pages_equal_brute_force():
    import random

    rng = random.Random(6)
    dropped = 0
    for _ in range(60):
        blocks = ["word " * rng.choice([1, 1, 2, 3, 60, 90]) + str(i) for i in range(rng.randint(2, 25))]
        for sigma, threshold in ((1.0, 0.5), (0.4, 0.5), (2.0, 0.9)):
            got = html_text.main_text(_page(*blocks), sigma, threshold)
            assert got == brute_flat(_page(*blocks), sigma, threshold)
            dropped += len(got) < len(" ".join(blocks))
    assert dropped > 20


def test_ratio_smoothing_and_threshold_decide():
    long = "word " * 80 + "end"
    flat = _page("Home", "News", "Sport", "Mail", "Title", long, long, "So it ends", "Terms", "Privacy", "Imprint", "Help")
    normal = html_text.main_text(flat)
    assert normal.startswith("Mail Title word") and normal.endswith("So it ends Terms")
    assert html_text.main_text(flat, sigma=0.2).startswith("word")  # smoothing lends the title its neighbours' ratio
    assert html_text.main_text(flat, threshold=0.0).startswith("Home News")
    spread = "<html><body>" + "".join(f"<p>{'<b>x</b>' * 60}{long}</p>" if p == "tags" else f"<p>{p}</p>" for p in ("a b", "c d", "e f", "g h", long, "i", "j", "k", "l", "tags")) + "</body></html>"
    assert html_text.main_text(spread).count("end") == 1  # as long a text among many tags is no content
    teasers = "".join(f"<article><h2>Teaser {i}</h2><p>More</p></article>" for i in range(6))
    marked = f"<html><body><div><article><h1>Head</h1><div><p>By</p><p>Me</p></div><p>{long}</p><p>{long}</p><section><h2>Last</h2><p>bit</p></section></article></div><div>{teasers}</div></body></html>"
    assert html_text.main_text(marked) == f"Head By Me {long} {long} Last bit"
    assert "Teaser 5" in html_text.main_text(marked, threshold=0.0)


WORDS = {"en": "the cat and the dog with this house of that man", "de": "der hund und die katze mit dem haus von einem mann", "fr": "le chat et le chien avec la maison de cet homme"}


def _docs(spark):
    return spark.createDataFrame([(i, f"{w} {w}", lang) for i, (lang, w) in enumerate(list(WORDS.items()) * 5)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")


def test_text_declared_language_and_host_are_fused(spark):
    rows = [(i, f"https://{lang}.site.org/{lang}/{i}", PAGE.format(lang=lang, text=WORDS[lang])) for i, lang in enumerate(["en", "de", "fr"] * 6)]
    rows += [(100, "https://de.site.org/de/x", "<html></html>"), (101, "https://fr.site.org/fr/y", PAGE.format(lang="en", text=WORDS["fr"] * 5)), (102, None, None)]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS lang"), _docs(spark)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == lang and got[i].probability > 0.9 for i, lang in enumerate(["en", "de", "fr"] * 6))
    assert got[100].lang == "de"  # no text: the host's other pages and the address
    assert got[101].lang == "fr" and got[101].declared == "en"
    assert got[102].lang in WORDS and got[102].host == ""


def test_language_id_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.org/", "<p>text</p>")], "page_id long, url string, html string")
    assert language_id.identify(pages.limit(0), _docs(spark)).count() == 0
    row = language_id.identify(pages, _docs(spark).limit(0)).first()
    assert row.lang is None and row.probability == 0.0


LONG = "This is a rather long paragraph of an article, with words enough to be content of the page. "


def _article(inner):
    return f"<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{LONG * 3}</p>{inner}<p>{LONG * 2}end.</p></article><footer>f</footer></body>"


@pytest.mark.parametrize(
    ("inner", "stays"),
    [
        ('<section id="search-history"><p>Old {}</p></section>', True),
        ('<div class="login-guide"><p>Old {}</p></div>', True),
        ('<p class="tags">Old {}</p>', True),
        ('<div class="social-history"><p>Old {}</p></div>', True),
        ('<p class="tags"><a>Old {}</a></p>', False),
        ('<div class="ad">Old {}</div>', False),
        ('<div class="related-posts"><p>Old {}</p></div>', False),
        ('<div class="entry-footer">Old {}</div>', False),
        ('<div id="comment-12">Old {}</div>', False),
        ('<div class="notice">Old {}</div>', False),
        ('<ul class="tags"><li><a>Old {}</a></ul>', False),
    ],
)
def test_class_words_that_articles_use_too(inner, stays):
    text = html_text.main_text(_article(inner.format(LONG)))
    assert (f"Old {LONG.strip()}" in text) == stays
    assert text.startswith("Title This") and text.endswith("end.")


def test_articles_of_one_doubtful_part_and_headings_before_them():
    assert html_text.main_text(f'<body><article><section id="search-history"><p>{LONG}</p></section></article></body>') == LONG.strip()
    assert html_text.main_text(f"<body><header><h1>Site</h1></header><h1>Own</h1><article><p>{LONG}</p></article></body>") == f"Own {LONG.strip()}"
    assert html_text.main_text(f"<body><h1>Site</h1><article><h1>Own</h1><p>{LONG}</p></article></body>") == f"Own {LONG.strip()}"
