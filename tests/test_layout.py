"""Statement pages by hand: levels, wraps, starts, rows and columns."""

from __future__ import annotations

import time

import pytest

from tallyflow.operators.layout import headers, rows_of, unreadable

LINE = "statement long, page int, block int, block_y double, line int, line_y double, x double, width double, text string"
HEAD = [(39.9, 10, 30, "Date"), (41.1, 80, 60, " Details "), (38.2, 200, 50, "Debit"), (40.0, 300, 50, "Credit"), (40.2, 400, 50, "Balance"), (45.0, 205, 20, "INR"), (52.0, 90, 20, "of"), (60.0, 81, 20, "it"), (70.0, 81, 20, "late")]


def block(page, number, top, lines, statement=1):
    return [(statement, page, number, float(top), i, float(y), float(x), float(w), t) for i, (y, x, w, t) in enumerate(lines)]


def row(y, *texts):
    return [(y + d, x, 40, t) for (d, x), t in zip(((0, 10), (0.9, 80), (1.8, 180), (0, 390)), texts, strict=False)]


@pytest.fixture(scope="module")
def pages(spark):
    lines = block(1, 0, 5, [(5, 10, 90, "01/02/2024 issued")]) + block(1, 1, 38, HEAD)
    lines += block(1, 2, 80, [*row(80, "01/02/2024", "tea", "5.00", "95.00"), (80.5, 12, 40, "02/02/2024"), (88, 500, 9, "far right"), (89, 81, 40, None)])
    lines += block(1, 3, 100, row(100, "03/02/2024", "rent", "40.00", "55.00"))
    # no header: a dated notice, then a block of five lines that stands alone, then the run of three
    lines += block(2, 0, 10, [(10, 10, 90, "04/02/2024 notice")]) + block(2, 1, 20, [*row(20, "05/02/2024", "lone", "1.00", "2.00"), (21, 300, 5, "x")]) + block(2, 2, 40, [(40, 10, 9, "break")])
    for k in range(3):
        lines += block(2, 3 + k, 60 + 20 * k, [*row(60 + 20 * k, f"0{6 + k}/02/2024", f"run{k}", "1.00", "9.00"), (60.4 + 20 * k, 300, 5, "7.00")])
    # no run of three: the first block that is full
    lines += block(3, 0, 10, [(10, 10, 90, "08/02/2024 notice")]) + block(3, 1, 20, [*row(20, "09/02/2024", "only", "1.00", "2.00"), (21, 300, 5, "x")])
    lines += block(1, 0, 5, row(5, "01/01/2024", "a", "b", "c"), statement=2)
    lines += block(1, 0, 5, [*row(5, "01/01/2024", "a", "b", "c"), (5, 300, 5, "d")], statement=3) + block(2, 1, 38, HEAD, statement=3)
    return spark.createDataFrame(lines, LINE)


def test_headers_group_within_two_units_and_take_three_wrapped_levels(pages):
    found = {(r.statement, r.page): (r.header_y, [c.text for c in r.columns], [c.end_x for c in r.columns]) for r in headers(pages).collect()}
    assert found == {k: (38.0, ["Date", "Details of it", "Debit INR", "Credit", "Balance"], [40.0, 140.0, 250.0, 350.0, 450.0]) for k in ((1, 1), (3, 2))}
    assert [r.statement for r in unreadable(pages).collect()] == [2]


def test_rows_and_columns(pages):
    got = {(r.statement, r.page, r.row_no): tuple(r.cells[c] for c in ("Date", "Details of it", "Debit INR", "Credit", "Balance")) for r in rows_of(pages).collect()}
    assert got == {
        (1, 1, 1): ("01/02/2024", "02/02/2024 tea far right", "5.00", "", "95.00"),
        (1, 1, 2): ("03/02/2024", "rent", "40.00", "", "55.00"),
        **{(1, 2, k + 1): (f"0{6 + k}/02/2024", f"run{k}", "1.00", "7.00", "9.00") for k in range(3)},
        (1, 3, 1): ("09/02/2024", "only", "1.00", "x", "2.00"),
    }


def test_a_long_page_is_read_line_by_line(spark):
    """Each row's work must not grow with the page; lines of one number and place go by their text."""
    lines = block(1, 0, 38, HEAD)
    for k in range(1500):
        lines += block(1, 1 + k, 100 + 20 * k, [*row(100 + 20 * k, "03/02/2024", f"a{k}", "1.00", "9.00"), (110 + 20 * k, 81, 40, "more")])
    lines += [(*lines[-1][:4], 4, lines[-1][5], 81.0, w, t) for w, t in ((5.0, "z"), (9.0, "b"))]
    pages = spark.createDataFrame(lines, LINE)
    began = time.time()
    got = {r.row_no: r.cells["Details of it"] for r in rows_of(pages).collect()}
    assert got == {k + 1: f"a{k} more" for k in range(1499)} | {1500: "a1499 b more z"} and time.time() - began < 30


def test_no_lines(pages):
    none = pages.filter("false")
    assert headers(none).count() == 0 and rows_of(none).count() == 0 and unreadable(none).count() == 0
