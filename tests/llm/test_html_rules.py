"""Which lines of a page the windows choose, and which containers they may leave out."""

import random
import re
import time

import pyarrow.parquet as pq

from scriptorium.llm import op1_html

LONG = "A sentence that is part of a long text. " * 12
WANT = LONG.strip()


def test_windows_choose_on_pages_with_an_article():
    """The element is a weight: a far longer text beside a teaser stands, a short one does not, and window and share count."""
    assert op1_html.main_text(f"<article><p>A teaser.</p></article><div><p>{LONG}</p></div>") == f"A teaser.\n{WANT}"
    page = f"<p>Beside it.</p><article><h1>T</h1><p>{LONG}</p></article><p>Below it.</p>"
    assert op1_html.main_text(page) == f"T\n{WANT}"
    assert op1_html.main_text(page, window=9) == f"Beside it.\nT\n{WANT}\nBelow it."
    assert op1_html.main_text(page, share=0.001) == f"Beside it.\nT\n{WANT}\nBelow it."
    assert op1_html.main_text(f"<article><p>{LONG}</p></article><nav>n</nav><article><p>End.</p></article>") == f"{WANT}\nEnd."


def test_plain_containers_end_no_candidate():
    parts = ["Title", LONG, "Short.", LONG, "End."]
    for name in ("div", "section"):
        body = "".join(f"<{name}><p>{p}</p></{name}>" for p in parts)
        assert op1_html.main_text(f"<nav>menu</nav>{body}<footer>f</footer>") == "\n".join(p.strip() for p in parts)
    for body in (f"<p>{LONG}</p><aside><p>ad</p></aside><p>End.</p>", f"<div><div><p>{LONG}</p></div><div class=ad>ad</div><div>End.</div></div>"):
        assert op1_html.main_text(f"<nav>menu</nav>{body}<footer>f</footer>") == f"{WANT}\nEnd."
    assert op1_html.main_text(f"<div>Skip to content</div><nav>m</nav><div><h1>T</h1><p>{LONG}</p></div><footer>f</footer>") == f"T\n{WANT}"


def test_containers_of_the_article_stay():
    for article in (f"<article><h1>T</h1><p>{LONG}</p></article>", f"<main><h1>T</h1><p>{LONG}</p></main>", f"<div><h1>T</h1><p>{LONG}</p></div>"):
        for a, z in (("<div class='layout with-sidebar'>", "</div>"), ("<form action=x>", "</form>"), ("<form><div class=widget-area>", "</div></form>")):
            assert op1_html.main_text(f"{a}<nav>menu</nav>{article}<div class=sidebar>side</div>{z}<footer>f</footer>") == f"T\n{WANT}", (a, article)
    comments = "<div id=comments>" + f"<article><p>I agree. {LONG}</p></article>" * 3 + "</div>"
    assert op1_html.main_text(f"<article><p>Text.</p></article>{comments}") == "Text."
    assert op1_html.main_text(f"<form><main><p>Text.</p></main>{comments}</form>") == "Text."
    assert op1_html.main_text("<nav>Home of the site</nav><p>x</p><footer>all rights</footer>") == "x"


def test_header_of_an_article_stays():
    for head in ("<div class='entry-header'><h1>T</h1></div>", "<div id=header><h1>T</h1></div>", "<header class=header><h1>T</h1></header>"):
        assert op1_html.main_text(f"<article>{head}<p>{LONG}</p></article>") == f"T\n{WANT}"
    assert op1_html.main_text(f"<div class=header>Site</div><div><header class=entry-header><h1>T</h1></header><p>{LONG}</p></div>") == f"T\n{WANT}"


def test_windows_against_brute_force():
    rnd = random.Random(1)
    for _ in range(500):
        sizes, window = [rnd.choice((0, 0, 0, 5, 9)) for _ in range(rnd.randrange(0, 30))], rnd.randrange(1, 6)
        sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
        surges = [i for i in range(len(sizes)) if sums[i] > 0 and (i == 0 or sums[i - 1] == 0)]
        dives = [i for i in range(1, len(sizes)) if sums[i] == 0 and sums[i - 1] > 0] + [len(sizes)]
        assert op1_html.candidates(sizes, window) == [(a, min(d for d in dives if d > a)) for a in surges]


def test_odd_markup_takes_linear_time():
    for piece, end in (("<a \"", ""), ("<div>", ""), ("<div></p>", ""), ("<head>", ""), ("<script ", ""), ("<p x='", ""), ("<!--", ""), ("<b", ""), ("<td class=menu>x", ""), ("text <", ">")):
        began = time.time()
        op1_html.main_text(piece * (1_000_000 // len(piece)) + end)
        assert time.time() - began < 20, piece
    assert op1_html.main_text(f"<p>{LONG}</p><p title=\"open>more words</p><p>last words</p>") == f"{WANT}\nmore words\nlast words"


def test_names_of_sections_are_weak_evidence():
    """Sections of an article may be named like page parts; their text decides, but reader comments go."""
    for name in ("related-work", "legal", "search-algorithm", "share", "reply", "notice-of-results"):
        assert op1_html.main_text(f"<article><p>{LONG}</p><section class={name}><h2>H</h2><p>{LONG}</p></section></article>") == f"{WANT}\nH\n{WANT}", name
        links = "<li><a href=x>A link to a page</a></li>" * 4
        assert op1_html.main_text(f"<article><p>{LONG}</p><div class={name}><ul>{links}</ul></div><p>End.</p></article>") == f"{WANT}\nEnd.", name
        assert op1_html.main_text(f"<article><p>{LONG}</p></article><div class={name}><p>{LONG}</p></div>") == WANT, name
    for name in ("comments", "ad", "cookie-notice", "notice", "newsletter"):
        assert op1_html.main_text(f"<article><p>{LONG}</p><section class={name}><p>{LONG}</p></section></article>") == WANT, name


def test_buttons_in_running_text_stay():
    assert op1_html.main_text(f"<article><p>{LONG}</p><p>Press <button class=b>Save</button> to save.</p><button>Share</button></article>") == f"{WANT}\nPress Save to save."
    assert op1_html.main_text(f"<article><p>{LONG}</p><ul><li><button>Like</button></li></ul><p>End <button>open</p><p>More.</p></article>") == f"{WANT}\nEnd open\nMore."


def test_lines_of_links_and_teasers():
    links = "<li><a href=x>Another page</a></li>"
    page = f"<article><p>{LONG}</p><p>End.</p><ul>{{}}</ul></article>"
    assert op1_html.main_text(page.format(links * 5)) == f"{WANT}\nEnd."
    assert op1_html.main_text(page.format(links)) == f"{WANT}\nEnd.\nAnother page"
    assert op1_html.main_text(f"<article><p>A.</p><ul>{links * 5}</ul><p>{LONG}</p></article>") == "\n".join(["A."] + ["Another page"] * 5 + [WANT])
    card = "<article><h3><a href=x>Title of another</a></h3><p>A teaser.</p></article>"
    assert op1_html.main_text(f"<article><p>{LONG}</p></article>{card}<article><p>End.</p></article>") == f"{WANT}\nEnd."
    assert op1_html.main_text(card) == "Title of another\nA teaser."
    assert op1_html.main_text(f"<div><div>{links}</div><div>{links}</div></div><div>© all</div>") != ""


def _bare(page):
    """The page without what names its parts: containers are all div, and have no class."""
    page = re.sub(r"(</?)(?:article|main|nav|header|footer|aside|section|ul|li)\b", r"\1div", page or "")
    return re.sub(r"\s(?:class|id)=\"[^\"]*\"", "", page)


def test_windows_decide_on_pages_without_names(sf, monkeypatch):
    """Article texts of the tables are found when nothing is named; a whole page in place of windows finds fewer."""
    pages = [p["html"] for p in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).to_pylist()]
    want = [op1_html.main_text(p) for p in pages]
    right = sum(op1_html.main_text(_bare(p)) == w for p, w in zip(pages, want, strict=True))
    assert right >= 0.95 * len(pages)
    monkeypatch.setattr(op1_html, "candidates", lambda sizes, window: [(0, len(sizes))] if any(sizes) else [])
    monkeypatch.setattr(op1_html, "surge", lambda sizes, window, start, stop, rise: start)
    assert sum(op1_html.main_text(_bare(p)) == w for p, w in zip(pages, want, strict=True)) < right


def test_articles_against_brute_force(sf):
    """Whole texts of the tables' pages, from their article element by patterns alone."""
    import html

    for p in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).to_pylist():
        inner = re.search(r"<article[^>]*>(.*?)</article>", p["html"] or "", re.S)
        if inner:
            body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner[1], flags=re.S)
            body = re.sub(r"<br\b[^>]*>", " ", body)
            body = re.sub(r"</?(?:p|h[1-6]|div|ul|ol|li|pre|blockquote|section|table|tr|td)\b[^>]*>", "\0", body)
            lines = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", x)).split()) for x in body.split("\0")]
            assert op1_html.main_text(p["html"]) == "\n".join(x for x in lines if x)


def test_surge_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        sizes, window = [rnd.choice((0, 3, 5, 90)) for _ in range(rnd.randrange(1, 30))], rnd.randrange(1, 6)
        sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
        assert op1_html.surge(sizes, window, 0, len(sizes), 0.25) == next(i for i, n in enumerate(sums) if n >= 0.25 * max(sums))
