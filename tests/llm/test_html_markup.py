"""Markup of odd pages: quotes in tags, hidden elements, teasers, very long pages, empty tables."""

import time

import pytest

from lendframe.llm import html_extraction as H


def text(html):
    root = H.parse(html)
    H.digest(root)
    main, kinds = H._kinds(root)
    return H.main_text(root, main, kinds, {})


@pytest.mark.parametrize("html, want", [
    ('<p title="a < b">text</p>', "text"),
    ("<p title=it's>text</p>", "text"),
    ('<img alt="a<b > c">text', "text"),
    ('<a href=?a="b>c</a> d < e & f <3', "c d < e & f <3"),
    ('<a href="x>lost <b>kept</b>', "lost kept"),
    ("<a href='" * 50, ""),
    ("a<p", "a"),
    ("<!-->b<!--->c<!-- x -->d<!doctype y>e<?php z?>f</>g</ 1>h<!-- open", "bcdefgh"),
    ("<p>1<p>2<li>3<li>4<hr>5", "1\n2\n3\n4\n5"),
    ("<p hidden>x</p><p>y</p><p style='color:red; Display : none'>x</p><p aria-hidden=true>x</p><p aria-hidden=false>z", "y\nz"),
    ("<article>story</article><article class=teaser>more</article><aside><article>other</article></aside>", "story"),
    ("<div class=with-sidebar><article>story</article></div>", "story"),
    ("<aside><article>other</article></aside><div>story</div>", "story"),
    ("<textarea><b>x</textarea>y<script>a<b</script>z", "y\nz"),
    ("", ""),
])
def test_markup(html, want):
    assert text(html) == want


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + "</span>" * n, lambda n: "<b>" * n + "<p></p>" * n, lambda n: "<li><b>" + "<b>" * n + "<li></li>" * n,
    lambda n: "<a href='x" * n, lambda n: '<a href="' * n + ">", lambda n: "<a b=" * n, lambda n: "<" * n, lambda n: "<!--" * n,
    lambda n: "<script>" * n])
def test_time_grows_with_the_page(page):
    began = time.process_time()
    text(page(60_000))
    assert time.process_time() - began < 10  # a second or less; minutes if marks were looked for from each tag on


def test_empty_table_long_page_and_clashing_columns(spark):
    shape = "page_id long, url string, html string, th int, host int, hash int, marks int, kind int"
    rows = [(1, "http://a.org", "<article>" + "<p>some words</p>" * 200_000, 1, 2, 3, 4, 5), (2, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, shape)
    got = {r.page_id: r.text for r in H.extracted(table).collect()}
    assert got == {1: "\n".join(["some words"] * 200_000), 2: ""}
    assert H.extracted(table.limit(0)).collect() == []


def test_pages_are_shuffled_compressed(spark, monkeypatch):
    pages = ["<main>" + f"<p>schöne Zeile {k} 🙂</p>" * 500 + "</main>" for k in range(3)] + ["", None]
    table = spark.createDataFrame([(k, "http://a.org", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    plain, seen = H.mapped, []
    monkeypatch.setattr(H, "mapped", lambda df, *a: seen.append(df) or plain(df, *a))
    got = {r.page_id: r.text for r in H.extracted(table).collect()}
    assert got == {k: "\n".join([f"schöne Zeile {k} 🙂"] * 500) if k < 3 else "" for k in range(5)}
    assert "html" not in seen[-1].columns
    sizes = [(r["size"], len(r["packed"])) for r in seen[-1].orderBy("page_id").collect()]
    assert [s for s, _ in sizes] == [len((x or "").encode()) for x in pages] and all(20 * n < s for s, n in sizes[:3])
