"""The page scanner: quotes, unclosed tags, very long pages, all given pages."""

import random
import time

import pytest

from feedloom.llm import extraction


def blocks(page):
    return [b.text for b in extraction.leaf_blocks(page)]


@pytest.mark.parametrize("page, texts", [
    ("<article><p title=it's>Some content here</p><p>We don't mind.</p><p>Last one</p></article>", ["Some content here", "We don't mind.", "Last one"]),
    ("<p class=it's>Hello</p>", ["Hello"]), ("<p a='x>y' b=\"</p>\">t</p>", ["t"]), ("1 < 2 and <b", ["1 < 2 and <b"]), ("<p a = 'b>c'>x", ["x"]),
    ('<p a="x>one</p><p>two</p>', ["one", "two"]), ("<p a=>x</p>", ["x"]), ("<p =\"a>b\">x</p>", ["x"]), ("<!-- a > b --><p>x<!-- y</p>", ["x"]),
    ("<!DOCTYPE html><?pi?>x", ["x"]), ("<script>if (a < b) '</p>'</script>x<style>p>q{}", ["x"]), ("<p>a</ p>b", ["a</ p>b"]), ("", []), ("<", ["<"]), ("<a", ["<a"])])
def test_pages_by_hand(page, texts):
    assert blocks(page) == texts


def walk(page):
    """Tags of a page that has neither raw elements nor comments, letter by letter; None where quotes swallow the rest."""
    out, at = [], 0
    while at < len(page):
        if page[at] != "<" or at + 1 == len(page) or not (page[at + 1].isalpha() or page[at + 1] == "/" and page[at + 2:at + 3].isalpha()):
            at += 1
            continue
        start, quote, value = at, None, False
        at += 1 + (page[at + 1] == "/")
        while at < len(page) and page[at] not in " \n/>":        # the name
            at += 1
        while at < len(page):
            c = page[at]
            if quote:
                quote = None if c == quote else quote
            elif c == ">":
                break
            elif value and c in "'\"":
                quote = c if c in page[at + 1:] else None
            value = not quote and (c == "=" or value and c.isspace())
            at += 1
        if at == len(page):
            return out if ">" not in page[start:] else None
        out.append(page[start:at + 1])
        at += 1
    return out


def test_tags_equal_a_walk_letter_by_letter():
    r, seen = random.Random(7), 0
    for _ in range(20_000):
        page = "".join(r.choice(["<a", "</a", "<b ", ">", "=", "'", '"', " ", "x", "/", "\n"]) for _ in range(r.randint(0, 14)))
        want = walk(page)
        if want is None:
            continue
        seen += bool(want)
        got = ["<" + closing + tag + attributes + ">" for _, _, closing, tag, attributes in extraction.tokens(page) if tag]
        assert got == want, page
    assert seen > 5_000


@pytest.mark.parametrize("part", ["<a ", "<a b='", '<a b=">"', "<!", "<script ", "<title", "</a ", "<a =", "<!--"])
def test_time_grows_with_the_page(part):
    page = part * (10_000_000 // len(part))
    begun = time.time()
    for _ in extraction.tokens(page):
        pass
    assert time.time() - begun < 20


def test_a_very_long_page_and_all_given_pages(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    long = spark.createDataFrame([(-1, "u", "<html><body><article>" + "<p>Plain words of a long story that goes on. And on it goes.</p>" * 40_000 + "</article></body></html>"), (-2, None, None), (-3, "u", "")],
                                 "page_id long, url string, html string")
    got = {r.page_id: r for r in extraction.extract(given.select("page_id", "url", "html").unionByName(long)).collect()}
    assert len(got) == given.count() + 3 and got[-2].text == got[-3].text == "" and got[-1].text.count("Plain words") == 40_000
    for r in got.values():
        assert r.n_chars == len(r.text) and r.text == "\n\n".join(" ".join(b.split()) for b in r.text.split("\n\n")) and "<p" not in r.text
    whole = {r.page_id: set(blocks(r.html or "")) for r in given.collect()}
    assert all(set(got[i].text.split("\n\n")) - {""} <= texts for i, texts in whole.items()) and sum(bool(r.text) for r in got.values()) > 0.9 * len(got)
