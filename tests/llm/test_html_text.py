"""Main text of whole pages, stated by hand."""

import time

from palaver.llm import html

S = "The river was high that spring and nobody in the village could remember such a flood in all the years before."
TREE = html.trained_tree()


def text(page):
    return html.extract(page, TREE)


def test_article_without_what_is_around_it():
    page = f"""<!DOCTYPE html><html><head><title>No title</title><style>p {{}}</style><script>if (a < b) write("</p>")</script></head><body>
    <header><h1>Daily</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-banner"><p>{S}</p></div>
    <main><article class="post"><h1>The &quot;flood&quot;</h1><p>{S} &amp; more&nbsp;water</p><div class='ad'>{S}</div><p>Short.</p>
    <aside>{S}</aside><!-- <p>comment</p> --><p>A <b>bold</b>\n  <a href=x>link</a>, then<br>more</p><form><label>Mail</label><input></form></article></main>
    <section id="comments"><p>{S}</p></section><footer>{S}</footer></body></html>"""
    assert text(page) == f'The "flood"\n{S} & more water\nShort.\nA bold link, then more'


def test_broken_markup():
    assert text(f"<article><h1>One</h1><p><b>{S}<br><p>Two<p>{S}</article><footer>x") == f"One\n{S}\nTwo\n{S}"
    assert text(f"<article><p>{S}</p><p>Cut off he") == f"{S}\nCut off he"
    assert text(f"<article><p>{S}</p><p class=\"x") == S
    assert text(f"<article><p>1 < 2 and 3 > 2</p><p>{S}</p></article>") == f"1 < 2 and 3 > 2\n{S}"
    assert text(f"<article><p>{S}</p></div></section><p>After</p></article>") == f"{S}\nAfter"
    assert text(f"<div class=ad><article><p>{S}</p></article>") in ("", S)


def test_page_without_article():
    page = f"<div><a href=a>Home</a> | <a href=b>News</a> | <a href=c>More</a></div><div><h1>The flood</h1><p>{S}</p><p>{S}</p></div><div>Copyright 2024 all rights reserved here</div>"
    assert text(page) == f"The flood\n{S}\n{S}"


def test_names_around_an_article():
    article = f"<article><h1>One</h1><p>{S}</p></article>"
    for around in ("class='layout has-sidebar'", "class='page no-sidebar'", "id=main-menu-wrapper", "class=page--with-banner", "class='nav-open search-enabled'", "title='id=ad class=ad'"):
        assert text(f"<div {around}>{article}</div>") == f"One\n{S}", around
    assert text(f"<form id=all>{article}<p>Your mail</p></form>") == f"One\n{S}"
    for own in ("post comments-enabled", "copyright-law article", "story share-price"):
        assert text(f"<div class='{own}'><h1>One</h1><p>{S}</p></div>") == f"One\n{S}", own
    for other in ("class=google-ads", "class=cookie-notice", "id=left-sidebar", "class='box comments'", "class=relatedPosts", "hidden", "style='display: none'", "role=complementary"):
        assert text(f"{article}<div {other}><p>{S}</p></div>") == f"One\n{S}", other
    assert text(f"{article}<ol class=comment-list><li><article class=comment-body><p>{S}</p></article></ol>") == f"One\n{S}"
    assert text(f"{article}<aside><article><p>{S}</p></article></aside>") == f"One\n{S}"


def test_quotes_and_elements_left_open():
    assert text(f"<article><p title='it's'>{S}</p><p title=\"a > b\">Two</p><p data-x=\"5 >{S}</p></article>") == f"{S}\nTwo\n{S}"
    assert text(f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><p>{S}</p></article>") == f"So x=2 holds\n{S}"
    assert text(f"<article><p>{S}</p><object><p>After</p></article>") == f"{S}\nAfter"
    assert text(f"<article><p>{S}</p><object>none<p>of it</p></object><!--><p>After</p></article>") == f"{S}\nAfter"


def test_time_grows_with_the_page():
    for part in ('<a ', "<div>", "<object>", "</p><i>", "<svg x='", "<!-- ", "<p class=\"ad ", "<div></b>", "<a =\"", "< a"):
        start = time.perf_counter()
        text(part * 100_000 + '"')
        assert time.perf_counter() - start < 5, part


def test_nothing_to_find():
    assert text(None) == text("") == text("<nav><a href=x>Home</a></nav>") == text("<script>x") == ""


def test_labelled_table_is_learned():
    for page, labels in html.LABELLED:
        assert [html.decide(TREE, r) for r in html.rows_of(html.blocks(page))] == labels, page[:90]


def test_table(spark):
    long = f"<article><p>{'word ' * 200_000}</p></article>"
    rows = [(1, "u", f"<article><p>é {S}</p></article>", "a"), (1, "u", f"<article><p>é {S}</p></article>", "a"), (2, None, None, "b"), (None, "v", long, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = sorted(map(tuple, html.main_text(pages).collect()), key=str)
    assert found == sorted([(1, "u", f"é {S}", len(S) + 2)] * 2 + [(2, None, "", 0), (None, "v", ("word " * 200_000).strip(), 999_999)], key=str)
    assert html.main_text(pages.limit(0)).count() == 0
