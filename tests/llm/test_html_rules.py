import re
import time

import pytest

from stationflow.llm import html_extract

SF1 = "/root/testdata/sf0.01"
PROSE = ("It was the best of times and it was the worst of times, and the age of the one was the age of all that there is to be had by those who would have it so. " * 2).strip()
ARTICLE = f"<article><p>{PROSE}</p></article>"


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar">{ARTICLE}</div>', f'<div id="page" class="no-banner"><main><p>{PROSE}</p></main></div>', f'<div class="search-results">{ARTICLE}</div>',
    f'<div class="site menu-closed">{ARTICLE}</div>', f'<form id="aspnetForm">{ARTICLE}</form>', f'<div class="notice" hidden><main>{PROSE}</main></div>', f'<div class="layout-sidebar-right"><p>{PROSE}</p></div>',
    f'<header class="masthead">{ARTICLE}</header>', f'<div class="sidebar">{ARTICLE}</div>',
])
def test_wrappers_of_the_article_are_read(page):
    assert html_extract.main_text(f"<body>{page}</body>") == PROSE


@pytest.mark.parametrize("inner", [
    '<section class="responses"><p>no</p></section>', '<ol class="replies"><li>no</li></ol>', '<div class="adbox">no</div>', '<div class="sidebar-left"><p>no</p></div>', '<div class="site-footer">no</div>',
    '<section id="comments"><article id="c1"><p>no</p></article></section>', '<div class="related-posts"><article><p>no</p></article></div>', '<div class="cookie-banner">no</div>', '<ul class="nav-list"><li>no</li></ul>', '<div style="display: none">no</div>',
])
def test_boilerplate_by_name_goes(inner):
    assert html_extract.main_text(f"<article><p>{PROSE}</p>{inner}</article>") == PROSE
    assert html_extract.main_text(f"<div><p>{PROSE}</p>{inner}</div>") == PROSE


def test_comments_go_even_if_they_hold_all_articles():
    assert html_extract.main_text(f"<div><p>{PROSE}</p></div><section id='comments'><article id='c1'><p>{PROSE}</p></article></section>") == PROSE
    assert html_extract.main_text(f"<main><p>{PROSE}</p></main><div class='related'>{ARTICLE}</div>") == PROSE


def test_a_line_between_two_menus_of_an_article_is_one_of_them():
    menu = "<ul><li><a href=1>One thing</a></li><li><a href=2>Two things</a></li></ul>"
    assert html_extract.main_text(f"<article><p>{PROSE}</p>{menu}<p>And</p>{menu}<p>Last words.</p></article>") == f"{PROSE}\nLast words."


def plain_labels(found):
    """Both passes by their description, each block looking over all others."""
    first = []
    for i, (text, zone, links, heading) in enumerate(found):
        menu = lambda j: 0 <= j < len(found) and found[j][1] == "main" and found[j][2] > 0.9 and len(found[j][0]) < 70
        stops = html_extract.stop_density(text)
        if zone == "boiler":
            first.append("bad")
        elif zone == "main":
            lines = menu(i) and (menu(i - 1) or menu(i + 1))
            first.append("bad" if lines else "good" if links <= 0.2 and len(text) > 200 and stops >= 0.3 else "?")
        elif links > 0.2 or "©" in text or len(text) < 70 and links > 0:
            first.append("bad")
        else:
            first.append("good" if len(text) > 200 and stops >= 0.3 else "heading" if len(text) < 70 and heading else "?" if len(text) < 70 else "near" if stops >= 0.15 else "far")
    main = [i for i, x in enumerate(found) if x[1] == "main"]
    known = {i: first[i] for i in main if first[i] in ("good", "bad")}
    for i in main:
        if i not in known:
            before, after = max((j for j in known if j < i), default=None), min((j for j in known if j > i), default=None)
            first[i] = "bad" if before is not None and after is not None and known[before] == known[after] == "bad" else "good"
    if "good" not in first:
        first = ["good" if x in ("near", "far") else x for x in first]
    out = []
    for i, x in enumerate(first):
        before, after = (next((j for j in order if first[j] in ("good", "bad")), None) for order in (range(i - 1, -1, -1), range(i + 1, len(first))))
        good = lambda j: j is not None and first[j] == "good"  # noqa: B023, E731
        if x in ("good", "bad"):
            out.append(x == "good")
        elif before is None and after is None:
            out.append(True)
        else:
            d, e = (i - before if before is not None else len(first)), (after - i if after is not None else len(first))
            out.append(good(before) and d <= e or good(after) and e <= d or x == "near" and (good(before) or good(after)) or x == "heading" and good(after))
    return out


def test_both_passes_against_plain_loops_on_all_pages(spark):
    by: dict[str, int] = {}
    for r in spark.read.parquet(f"{SF1}/pages.parquet").collect():
        for page in (r["html"], re.sub(r"</?(?:article|main)\b[^>]*>", "<div>", r["html"])):
            found = html_extract.blocks(page)
            decided = html_extract.decisions(page)
            assert [k for _, k, _ in decided] == plain_labels(found)
            for _, _, how in decided:
                by[how] = by.get(how, 0) + 1
    print("blocks by what decided them:", by)
    assert by["inherited"] > 0 and by["rule"] > 0


@pytest.mark.parametrize("piece", ["<button ", "<style ", '<script a="', '<button a=">', "<svg a='>", "<div>", "</p><div>", "<article>", "<p a='x\" ", "<!-", '<a href="'])
@pytest.mark.parametrize("end", ["", ">"])
def test_hostile_pages_are_read_in_linear_time(piece, end):
    page = piece * (160_000 // len(piece)) + end
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 2
