"""Statement pages as lines with places: header, rows and columns.

A reader (``sources/statements.py``) gives one row for each line of text: (statement, page, block,
block_y, line, line_y, x, width, text). A block is a few lines that stand together, ``block_y`` its
upper edge; ``block`` and ``line`` count in reading order. Everything of one page is one bounded
array. Headers and pages' bodies are found by higher-order functions over it; rows and columns go by what
came before, line by line, and are read from Arrow batches of whole pages.
Lines without text or height take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import DATE

#: Lines that make a block a table's row, units of height that count as one line, lines a header may wrap on.
LEAST, NEAR, WRAPS = 5, 2.0, 3
PAGE = ["statement", "page"]

#: The fixture's statements and rows a page.
STATEMENTS, ROWS = 500, 12


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of statements. Heights jitter, amounts start left of their headers, a header
    wraps on a second line and stands on every third page; the others begin with a dated notice. Each
    row also has a value date, and every fourth a second line of text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), "o_orderstatus", (F.col("o_custkey") % STATEMENTS).alias("statement"))
    nth = F.row_number().over(Window.partitionBy("statement").orderBy("day", "o_orderkey")) - 1
    rows = orders.withColumn("nth", nth).select("*", (F.floor(F.col("nth") / ROWS) + 1).cast("int").alias("page"), (F.col("nth") % ROWS).cast("int").alias("r"))
    date, top, wide = F.date_format("day", "dd/MM/yyyy"), 60.0 + 20.0 * F.col("r"), F.col("o_orderkey") % 4 == 0
    in_row = [(10, 50, 0.0, date), (12, 50, 0.6, date), (80, 90, 1.2, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), (F.when(F.col("o_orderstatus") == "O", 390).otherwise(285), 50, 0.6, F.col("amount")),
              (480, 50, 0.0, F.concat((F.col("o_orderkey") * 10).cast("string"), F.lit(".00"))), (80, 60, 8.0, F.when(wide, F.concat(F.lit("ref "), F.col("o_orderkey").cast("string"))))]
    body = _placed(rows, F.col("r") + 2, top, [(x, w, top + y, t) for x, w, y, t in in_row])
    pages = rows.select(*PAGE).distinct()
    head = [(10, 30, 39.9, "Date"), (80, 90, 40.1, "Narration"), (300, 60, 41.2, "Withdrawal"), (400, 50, 40.0, "Deposit"), (500, 50, 39.5, "Balance"), (298, 40, 50.0, "Amount"), (402, 40, 50.3, "Amount")]
    title = _placed(pages, F.lit(0), F.lit(5.0), [(10, 200, F.lit(5.0), F.lit("Statement of account"))])
    header = _placed(pages.filter("page % 3 = 1"), F.lit(1), F.lit(38.0), [(x, w, F.lit(y), F.lit(t)) for x, w, y, t in head])
    notice = _placed(pages.filter("page % 3 <> 1"), F.lit(1), F.lit(38.0), [(10, 200, F.lit(40.0), F.lit("01/01/2024 new rates apply"))])
    return title.unionByName(header).unionByName(notice).unionByName(body)


def _placed(rows: DataFrame, block: Column, top: Column, cells: list[tuple]) -> DataFrame:
    def number(v: Column | float) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast("double")

    lines = F.array(*[F.struct(F.lit(i).alias("line"), number(y).alias("line_y"), number(x).alias("x"), number(w).alias("width"), t.alias("text")) for i, (x, w, y, t) in enumerate(cells)])
    return rows.select(*PAGE, block.cast("int").alias("block"), number(top).alias("block_y"), F.inline(lines)).filter(F.col("text").isNotNull())


def is_date(x: Column) -> Column:
    return F.trim(x).rlike(DATE)


def _blocks(lines: DataFrame) -> DataFrame:
    """One row for each block, dealt by page so that nothing after it moves again."""
    known = lines.filter(F.col("text").isNotNull() & F.col("line_y").isNotNull()).repartition(*PAGE)
    return known.groupBy(*PAGE, "block").agg(F.min("block_y").alias("block_y"), F.sort_array(F.collect_list(F.struct("line", "line_y", "x", "width", "text"))).alias("ls"))


def headers(lines: DataFrame) -> DataFrame:
    """SRC2: (statement, page, header_y, columns). In each block, lines within two units of the first
    of them are one level. The fullest level (the first of equals) is a header if it has five lines
    and the word date; a page's header is its first. Up to three levels below add their words to the
    column that starts nearest."""

    def level(y: Column) -> Column:
        return F.get(F.filter("levels", lambda k: F.abs(k - y) <= NEAR), F.lit(0))

    def joined(ks: Column, line: Column) -> Column:
        return F.when(F.exists(ks, lambda k: F.abs(k - line["line_y"]) <= NEAR), ks).otherwise(F.concat(ks, F.array(line["line_y"])))

    def nearest(x: Column) -> Column:
        return F.array_min(F.transform("heads", lambda h, i: F.struct(F.abs(h["x"] - x).alias("off"), i.alias("i"))))["i"]

    def titled(h: Column, i: Column) -> Column:
        more = F.transform(F.filter("wrapped", lambda w: nearest(w["x"]) == i), lambda w: F.trim(w["text"]))
        return F.struct(h["x"].alias("x"), i.alias("place"), (h["x"] + h["width"]).alias("end_x"), F.trim(F.concat_ws(" ", F.trim(h["text"]), F.concat_ws(" ", more))).alias("text"))

    dates = F.exists("ls", lambda v: v["text"].rlike(r"(?i)\bdate\b"))
    levels = _blocks(lines).filter((F.size("ls") >= LEAST) & dates).withColumn("levels", F.aggregate("ls", F.array().cast("array<double>"), joined))
    counts = F.transform("levels", lambda k, i: F.struct(F.size(F.filter("ls", lambda v: level(v["line_y"]) == k)).alias("n"), (-i).alias("first"), k.alias("y")))
    anchored = levels.withColumn("anchor", F.array_max(counts)).filter(F.col("anchor.n") >= LEAST).withColumn("heads", F.filter("ls", lambda v: level(v["line_y"]) == F.col("anchor.y")))
    dated = anchored.filter(F.exists("heads", lambda h: h["text"].rlike(r"(?i)\bdate\b")))
    below = F.slice(F.array_sort(F.filter("levels", lambda k: k > F.col("anchor.y"))), 1, WRAPS)
    wrapped = dated.withColumn("wrapped", F.flatten(F.transform(below, lambda k: F.filter("ls", lambda v: level(v["line_y"]) == k))))
    found = wrapped.withColumn("columns", F.array_sort(F.transform("heads", titled)))
    return found.groupBy(*PAGE).agg(F.min_by(F.struct("block_y", "columns"), "block").alias("h")).select(*PAGE, F.col("h.block_y").alias("header_y"), F.col("h.columns").alias("columns"))


def unreadable(lines: DataFrame) -> DataFrame:
    """Statements without a header on any page; they have no rows, and go to the vision reader."""
    return lines.select("statement").distinct().join(headers(lines).select("statement").distinct(), "statement", "left_anti")


def body(lines: DataFrame) -> DataFrame:
    """SRC3: (statement, page, columns, ls), ``ls`` the lines of the blocks below the page's header.
    A page without one begins at the first of three blocks in a row that have five lines each, else at
    the first that has, and takes the columns of the last page before it that had a header. Pages
    before any header go."""
    blocks = _blocks(lines).withColumn("full", F.size("ls") >= LEAST)
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("block", "block_y", "full", "ls"))).alias("bs")).join(headers(lines), PAGE, "left")

    def full(i: Column) -> Column:
        return F.coalesce(F.get("bs", i)["full"], F.lit(False))

    in_run = F.filter("bs", lambda b, i: full(i) & full(i + 1) & full(i + 2))
    start = F.coalesce(F.get(in_run, F.lit(0))["block"], F.get(F.filter("bs", lambda b: b["full"]), F.lit(0))["block"])
    known = F.last("columns", ignorenulls=True).over(Window.partitionBy("statement").orderBy("page"))
    begun = pages.withColumn("start", start).withColumn("columns", known).filter(F.col("columns").isNotNull())
    kept = F.filter("bs", lambda b: F.when(F.col("header_y").isNotNull(), b["block_y"] > F.col("header_y")).otherwise(F.coalesce(b["block"] >= F.col("start"), F.lit(False))))
    flat = F.flatten(F.transform(kept, lambda b: F.transform(b["ls"], lambda v: F.struct(v["line_y"].alias("line_y"), v["x"].alias("x"), b["block"].alias("block"), v["line"].alias("line"), v["text"].alias("text")))))
    return begun.select(*PAGE, "columns", flat.alias("ls"))


def _numbers(column: pa.Array) -> np.ndarray:
    """Nulls come before everything, as in Spark's order of structs."""
    return column.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _begun(ys: list[float]) -> list[int]:
    """Of places in order, those that stand two units or more from the last of them."""
    out: list[int] = []
    for i, y in enumerate(ys):
        if not out or not abs(y - ys[out[-1]]) < NEAR:
            out.append(i)
    return out


def reading_order(off: np.ndarray, y: np.ndarray, x: np.ndarray, block: np.ndarray, line: np.ndarray, text: pa.Array) -> np.ndarray:
    """SRC4: the order of the lines of pages ``off``, each from top to bottom; those less than two units
    below the first of them go from left to right."""
    page = np.repeat(np.arange(len(off) - 1), np.diff(off))
    down = np.lexsort((y, page))
    begins = np.zeros(len(y), np.int64)
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        begins[[lo + i for i in _begun(y[down[lo:hi]].tolist())]] = 1
    top = np.empty(len(y), np.int64)
    top[down] = np.cumsum(begins)
    order = np.lexsort((line, block, y, x, top))
    keys = [k[order] for k in (top, x, y, block, line)]
    tied = np.flatnonzero(np.logical_and.reduce([k[1:] == k[:-1] for k in keys]))
    if len(tied):  # lines of one number and place
        runs = np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1)
        for run in runs:
            own = order[run[0] : run[-1] + 2].tolist()
            order[run[0] : run[-1] + 2] = sorted(own, key=lambda i: text[i].as_py().encode())
    return order


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Page, number and cells of the rows of a batch of pages (.., columns, ls)."""
    columns, ls = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    off = np.asarray(ls.offsets).astype(np.int64)
    flat = ls.values.slice(off[0], off[-1] - off[0])
    off = off - off[0]
    page = np.repeat(np.arange(batch.num_rows), np.diff(off))
    y, x, block, line = (_numbers(flat.field(c)) for c in ("line_y", "x", "block", "line"))
    order = reading_order(off, y, x, block, line, flat.field("text"))
    y, x, text, blank = y[order], x[order], flat.field("text").take(pa.array(order)), np.asarray(flat.field("x").is_null())[order]
    dated = np.flatnonzero(flat.field("dated").fill_null(False).to_numpy(zero_copy_only=False)[order])
    opens = np.zeros(len(y), np.int64)
    edge = np.searchsorted(dated, off)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = dated[lo:hi]
        opens[own[_begun(y[own].tolist())]] = 1
    row = np.cumsum(opens)
    before = np.concatenate([[0], row])[off[:-1]]
    number = row - before[page]

    # a page's columns: where they end, and the first that has the same text
    heads = np.asarray(columns.offsets).astype(np.int64)
    wide = np.diff(heads)
    ends, same, names = np.full((len(wide), wide.max()), -np.inf), np.zeros((len(wide), wide.max()), np.int64), []
    where = _numbers(columns.values.field("end_x"))
    titles = columns.values.field("text").to_pylist()
    for i, (lo, n) in enumerate(zip(heads[:-1].tolist(), wide.tolist(), strict=True)):
        own = dict.fromkeys(titles[lo : lo + n])
        names.append(list(own))
        own = {t: k for k, t in enumerate(own)}
        ends[i, :n], same[i, :n] = where[lo : lo + n], [own[t] for t in titles[lo : lo + n]]
    here = number > 0
    page, x, blank, row, text = page[here], x[here], blank[here], row[here] - 1, text.filter(pa.array(here))
    fits = (ends[page] > x[:, None]) & ~blank[:, None]
    column = np.where(fits.any(axis=1), same[page, fits.argmax(axis=1)], 0)
    left = np.flatnonzero(column == 0)
    again = left[1:][row[left[1:]] == row[left[:-1]]]
    again = again[wide[page[again]] > 1]
    column[again] = same[page[again], 1] if len(again) else 0

    first = np.flatnonzero(opens)
    of = np.repeat(np.arange(batch.num_rows), np.diff(off))[first]
    cells = np.concatenate([[0], np.cumsum(np.array([len(n) for n in names], np.int64)[of])])
    place = cells[row] + column
    sizes = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=cells[-1]))])
    texts = text.take(pa.array(np.argsort(place, kind="stable"))).cast(pa.large_string())
    values = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(sizes), texts), pa.scalar(" ", pa.large_string()))
    keys = pa.array([t for i in of.tolist() for t in names[i]], pa.string())
    return of, number[first], pa.MapArray.from_arrays(pa.array(cells, pa.int32()), keys, values.cast(pa.string()))


def rows_of(lines: DataFrame) -> DataFrame:
    """SRC5, SRC6: (statement, page, row_no, cells). A date opens a row if it stands two units or more
    from the date that opened the one before; what precedes the first goes. A line belongs to the first
    column that ends right of where it starts, else to the leftmost; the leftmost holds one value, any
    other moves to the next column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                part = part.filter(pc.greater(pc.list_value_length(part.column(part.num_columns - 1)), 0))
                if part.num_rows:
                    of, number, cells = _read(part)
                    yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(of)) for k in range(len(PAGE))], pa.array(number.astype(np.int32)), cells], [*PAGE, "row_no", "cells"])

    ls = F.transform("ls", lambda v: F.struct(*[v[c].alias(c) for c in ("line_y", "x", "block", "line", "text")], is_date(v["text"]).alias("dated")))
    pages = body(lines).select(*PAGE, F.transform("columns", lambda c: F.struct(c["end_x"].alias("end_x"), c["text"].alias("text"))).alias("columns"), ls.alias("ls"))
    kinds = T.StructType([*[pages.schema[c] for c in PAGE], T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.MapType(T.StringType(), T.StringType()))])
    return pages.mapInArrow(read, kinds)


#: NRM1: canonical names of columns by the words their headers may hold; a pluggable stand-in.
SYNONYMS = {"date": "date", "description": "narration|description|particulars|details", "debit": "withdrawal|debit|paid out", "credit": "deposit|credit|paid in", "balance": "balance"}


def renamed(rows: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """NRM1, NRM2: cells under their canonical names; unmapped ones go."""

    def under(words: str) -> Column:
        found = F.map_filter("cells", lambda k, _: F.lower(k).rlike(words))
        return F.try_element_at(F.map_values(found), F.lit(1))

    return rows.select(*PAGE, "row_no", *[under(words).alias(name) for name, words in (synonyms or SYNONYMS).items()])


def src2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(fixture(spark, sf_dir)).select(*PAGE, "header_y", F.concat_ws("|", F.col("columns.text")).alias("columns"))


def src5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1-SRC6 end to end: the orders, read back from the pages they were set on."""
    return renamed(rows_of(fixture(spark, sf_dir)))


def src7_image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: under fifty characters of text in all means a scanned image."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", (F.length(F.regexp_replace("html", "<[^>]*>|\\s", "")) < 50).alias("is_image"))


def queries() -> dict:
    return {f.__name__: f for f in (src2_headers, src5_rows, src7_image_pages)}


_ORDERS = f"""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, o_orderstatus = 'O' AS paid_in, o_custkey % {STATEMENTS} AS statement,
       row_number() OVER (PARTITION BY o_custkey % {STATEMENTS} ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS nth FROM orders"""

#: What the pages must read back as, from the orders alone.
ORACLES = {
    "src2_headers": f"""SELECT DISTINCT statement, CAST(nth // {ROWS} + 1 AS INTEGER) AS page, CAST(38 AS DOUBLE) AS header_y, 'Date|Narration|Withdrawal Amount|Deposit Amount|Balance' AS columns
FROM ({_ORDERS}) AS o WHERE (nth // {ROWS}) % 3 = 0""",
    "src5_rows": f"""SELECT statement, CAST(nth // {ROWS} + 1 AS INTEGER) AS page, CAST(nth % {ROWS} + 1 AS INTEGER) AS row_no, day AS date,
       day || ' Order ' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN ' ref ' || o_orderkey ELSE '' END AS description,
       CASE WHEN paid_in THEN '' ELSE amount END AS debit, CASE WHEN paid_in THEN amount ELSE '' END AS credit, (o_orderkey * 10) || '.00' AS balance FROM ({_ORDERS}) AS o""",
    "src7_image_pages": "SELECT page_id, length(regexp_replace(html, '<[^>]*>|\\s', '', 'g')) < 50 AS is_image FROM pages",
}
