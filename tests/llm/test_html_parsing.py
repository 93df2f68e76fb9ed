"""Attributes, depth and names in odd pages."""

from __future__ import annotations

import time

import pytest

from lodestone.llm import html_text
from lodestone.llm.html_text import main_text

LONG = "This is a paragraph of the article and it says a number of things at some length. " * 3
PARTS = ["A heading", *(f"{i} {LONG}".strip() for i in range(3))]


def page(*attributes):
    a = [*attributes, "", "", "", ""]
    return f"<html><body><div id=x><h1 {a[0]}>{PARTS[0]}</h1>" + "".join(f"<p {b}>{t}</p>" for b, t in zip(a[1:], PARTS[1:])) + "</div></body></html>"


@pytest.mark.parametrize("odd", ["data-x=it's", 'title=5"', "'", '"', 'a="it\'s" b=\'5"\'', "alt='<b>' title=\"a > b\"", "x = 'a>b' y", "=x", "a==\"b\"", "href=a/b/", "a=", "onclick=f(\"x\")", "/", 'title="x class=menu"'])
def test_attributes_are_read_as_browsers_do(odd):
    assert main_text(page("", odd, "", odd)) == "\n\n".join(PARTS)
    assert main_text(page(odd)) == "\n\n".join(PARTS)


def test_the_first_attribute_of_a_name_counts():
    assert html_text._attributes(" ID=a id=b CLASS='c d' data-class=x hidden") == {"id": "a", "class": "c d", "hidden": ""}
    assert html_text._attributes(' title="x class=menu" role=main/') == {"role": "main/"}


@pytest.mark.parametrize("tag", ["section", "ul", "div", "span", "b", "li", "table", "p", "td", "blockquote", "a"])
def test_time_grows_with_the_page(tag):
    def took(n):
        began = time.perf_counter()
        text = main_text(f"<body><{tag}>" + f"<{tag}>word " * n)
        return time.perf_counter() - began, text.split().count("word")

    few, many = took(2000), took(16_000)
    assert many[1] == 16_000 and many[0] < max(1.0, 24 * few[0])
    assert many[0] < 2.5


def test_ends_without_beginnings_take_no_longer():
    began = time.perf_counter()
    main_text("<body>" + "<div><span>" * 8000 + "x" + "</i></b></em>" * 8000 + "<a href='" * 2000)
    assert time.perf_counter() - began < 2.5


def test_a_menu_of_dishes_belongs_and_one_of_links_does_not():
    dishes = "".join(f"<li>Dish number {i}, with rice and a sauce that is made of fresh herbs</li>" for i in range(30))
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(8))
    body = f"<body><nav>{links}</nav><article><h1>Our table</h1><p>{LONG}</p><section id='menu'><ul>{{}}</ul></section><p>{LONG}</p></article></body>"
    assert main_text(body.format(dishes)).count("Dish number") == 30
    assert "Section" not in main_text(body.format(links))
    board = main_text(f"<body><div class='notice-board'><h2>News</h2><p>{LONG}</p><p>{LONG}</p></div><div class='notice'>We use cookies.</div></body>")
    assert board.count("paragraph of the article") == 6 and "cookies" not in board
