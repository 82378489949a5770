"""Pages that must neither fail nor grow out of proportion."""

import random
import re
import time

import pytest

from paperloom.llm.op4_html import extract, visible_text

CRASHES = [
    ('<select size="\u00b2"><option>a<option>b</select>', "a"),
    ('<select size="' + "9" * 5000 + '"><option>a<option>b</select>', "a b"),
    (f'<table><tr><td colspan="{"7" * 5000}">a<td>b</table>', "a | b"),
    (f'<table><tr><td rowspan="{"7" * 5000}">a<td>b<tr><td>c</table>', "a | b\n  | c"),
    ('<table><tr><td colspan="\u0664" rowspan="\u00b3">a<td>b</table>', "a | b"),
    ('<ol start="\u00b2"><li>a<li value="' + "1" * 5000 + '">b</ol>', "1. a\n2. b"),
    ("<p>&#" + "9" * 5000 + ";&#x" + "f" * 5000 + ";&#65;</p>", "\ufffd\ufffdA"),
]


@pytest.mark.parametrize("page", range(len(CRASHES)))
def test_odd_numbers(page):
    source, want = CRASHES[page]
    assert visible_text(source).replace("\n\n", "\n") == want or visible_text(source).split() == want.split()


def spans(k, r, across=1000, down=65534):
    return "<table><tr>" + f"<td colspan={across} rowspan={down}>x" * k + "<tr><td>y" * r + "</table>"


@pytest.mark.parametrize("k, r", [(20, 20), (20, 200), (200, 20), (1000, 1000), (3000, 5000)])
def test_spans_stay_in_proportion(k, r):
    source = spans(k, r)
    began = time.time()
    text = visible_text(source)
    assert len(text) <= 8 * (len(source) + 4 * (k + r)) + 2048
    assert text.count("x") == k and text.count("y") == r
    assert time.time() - began < 20


def test_one_wide_cell_does_not_stretch_many_rows():
    source = "<table><tr><td>" + "w" * 50_000 + "<td>z" + "<tr><td>a<td>b" * 5_000 + "</table>"
    text = visible_text(source)
    assert len(text) < 2 * len(source) and text.endswith("a | b")


def test_small_tables_are_aligned():
    assert visible_text("<table><tr><th colspan=2>Head<th>N<tr><td>long cell<td>b<td>1<tr><td>c<td>d<td>22</table>") == "Head          | N\nlong cell | b | 1\nc         | d | 22"
    assert visible_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"
    # Columns in which no cell begins are none.
    assert visible_text("<table><tr><td colspan=50>a<td>b<tr><td colspan=50>cc<td>d</table>") == "a  | b\ncc | d"


def test_random_tables_end_and_keep_their_cells(spark):
    rng = random.Random(6)
    pages = []
    for i in range(300):
        cells = iter(range(1000))
        rows = ["".join(f"<t{rng.choice('dh')} colspan={rng.choice(['1', '2', '3', '0', 'x', '1000'])} rowspan={rng.choice(['1', '2', '0', '9', '-1'])}>c{next(cells)}e" for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 8))]
        pages.append((i, "<table><tr>" + "<tr>".join(rows) + "</table>"))
    for r in extract(spark.createDataFrame(pages, "i int, html string")).collect():
        source = dict(pages)[r.i]
        assert sorted(re.findall(r"c\d+e", r.text)) == sorted(re.findall(r"c\d+e", source)), source
