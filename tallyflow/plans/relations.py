"""Named relations: each is one SELECT over base tables and other relations.

A relation's text comes from a function of the SQL dialect, so the same definition runs as a
Spark plan (one WITH statement that Catalyst optimises as a whole) and as the plain SQL that the
results are checked against. Any relation can be replaced by a caller's DataFrame.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    name = "spark"

    def dow(self, x: str) -> str:
        """1 is Sunday."""
        return f"dayofweek({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"{x} RLIKE r'{pattern}'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{by}')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def count_up(self, lo: str, hi: str) -> str:
        return f"explode(sequence({lo}, {hi}))"

    def unnest(self, x: str) -> str:
        return f"explode({x})"

    def month_name(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM')"

    def rolled(self, y: str, m: str, d: str) -> str:
        """Calendar overflow rolls on: day 31 of a 30-day month is the next month's first."""
        return f"date_add(add_months(make_date({y}, 1, 1), {m} - 1), {d} - 1)"

    def add_days(self, x: str, n: str) -> str:
        return f"date_add({x}, {n})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def words(self, x: str) -> str:
        return f"split({x}, ' ')"

    def all_words(self, name: str, text: str) -> str:
        """Are all words of three letters or more of the name in the text, and is there one?"""
        long = f"filter(split({name}, r'\\s+'), w -> length(w) >= 3)"
        return f"(size({long}) > 0 AND forall({long}, w -> contains({text}, w)))"


class Duck(Spark):
    name = "duckdb"

    def dow(self, x: str) -> str:
        return f"(dayofweek({x}) + 1)"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def count_up(self, lo: str, hi: str) -> str:
        return f"unnest(generate_series({lo}, {hi}))"

    def unnest(self, x: str) -> str:
        return f"unnest({x})"

    def month_name(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m')"

    def rolled(self, y: str, m: str, d: str) -> str:
        return f"CAST(make_date({y}, 1, 1) + to_months(CAST({m} - 1 AS INTEGER)) + to_days(CAST({d} - 1 AS INTEGER)) AS DATE)"

    def add_days(self, x: str, n: str) -> str:
        return f"CAST({x} + to_days(CAST({n} AS INTEGER)) AS DATE)"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def words(self, x: str) -> str:
        return f"string_split({x}, ' ')"

    def all_words(self, name: str, text: str) -> str:
        long = f"list_filter(regexp_split_to_array({name}, '\\s+'), lambda w: length(w) >= 3)"
        return f"(len({long}) > 0 AND len(list_filter({long}, lambda w: NOT contains({text}, w))) = 0)"


SPARK, DUCK = Spark(), Duck()
RELATIONS: dict[str, Callable[[Spark], str]] = {}


def relation(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
    """Register the function's name as a relation."""
    RELATIONS[f.__name__] = f
    return f


def _needs(sql: str, own: str, given: frozenset[str]) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) if n in RELATIONS and n != own and n not in given]


def statement(name: str, dialect: Spark, given: frozenset[str] = frozenset(), swap: dict[str, str] | None = None) -> str:
    """The relation with all those below it as one WITH statement; ``swap`` reads other relations
    under the names of some."""
    if name not in RELATIONS:
        from . import catalog  # noqa: F401  importing it registers all relations
    parts: dict[str, str] = {}

    def add(n: str) -> None:
        sql = f"SELECT * FROM {swap[n]}" if swap and n in swap else RELATIONS[n](dialect).strip()
        for other in _needs(sql, n, given):
            if other not in parts:
                add(other)
        parts[n] = sql

    add(name)
    own = parts.pop(name)
    if not parts:
        return own
    return "WITH " + ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in parts.items()) + "\n" + (f"SELECT * FROM (\n{own}\n) AS result" if own.upper().startswith("WITH") else own)


def build(spark: SparkSession, name: str, **given: DataFrame) -> DataFrame:
    """The relation as a DataFrame; ``given`` replaces base tables or relations by name."""
    sql = statement(name, SPARK, frozenset(given))
    views = {n: f"{n}_{uuid.uuid4().hex}" for n in given}
    for n, view in views.items():
        given[n].createOrReplaceTempView(view)
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {view}", sql)
    try:
        return spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


#: Relations that are written once and read by all that name them.
MARTS: dict[str, str | None] = {}
_written: dict[tuple, DataFrame] = {}


def mart(partition: str | None = None) -> Callable[[Callable[[Spark], str]], Callable[[Spark], str]]:
    """Register the function's name as a relation that is kept as a table, laid out by ``partition``."""

    def add(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
        MARTS[f.__name__] = partition
        return relation(f)

    return add


def _below(name: str) -> list[str]:
    """The marts that the relation reads, through relations that are none."""
    found: dict[str, None] = {}
    seen: set[str] = set()

    def visit(n: str) -> None:
        for other in _needs(RELATIONS[n](SPARK), n, frozenset()):
            if other in MARTS:
                found[other] = None
            elif other not in seen:
                seen.add(other)
                visit(other)

    visit(name)
    return list(found)


def _state(spark: SparkSession, sf_dir: str, tables: list[str]) -> tuple:
    """What tells whether the tables' files are still those that a mart was made of."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{t}.parquet" for t in tables])
    return tuple(sorted((r.path, r.length, str(r.modificationTime)) for r in files.select("path", "length", "modificationTime").collect()))


def kept(spark: SparkSession, sf_dir: str, name: str, state: tuple) -> DataFrame:
    """A mart, written below ``spark.checkpoint.dir`` when it is first read, and again after the
    tables' files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, name, state)
    if key not in _written:
        df = _read(spark, sf_dir, name, state)
        place, by = shared_folder(spark, f"mart-{name}"), MARTS[name]
        writer = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
        writer.parquet(place)
        # partition columns would read back by the look of their values
        _written[key] = spark.read.schema(df.schema).parquet(place).select(df.columns)
    return _written[key]


def _read(spark: SparkSession, sf_dir: str, name: str, state: tuple | None = None, own: dict[str, DataFrame] | None = None) -> DataFrame:
    statement(name, SPARK)
    own = own or {}
    marts = [m for m in _below(name) if m not in own]
    sql = statement(name, SPARK, frozenset([*marts, *own]))
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    if marts and state is None:
        state = _state(spark, sf_dir, [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", statement(name, SPARK))])
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used} | {m: kept(spark, sf_dir, m, state) for m in marts}
    return build(spark, name, **given | own)


def query(name: str, **own: DataFrame) -> Callable[[SparkSession, str], DataFrame]:
    """The relation over the tables of a folder, by way of the marts below it. ``own`` frames take the
    place of relations that no mart below it reads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, name, own=own)

    return run


def nearest_rank(x: str, p: float | str, n: str = "n", rn: str = "rn") -> str:
    """Nearest rank over rows numbered ``rn`` of ``n`` by ``x``: the value at floor(p n) from 0."""
    return f"max(CASE WHEN {rn} = least(CAST(floor({p} * {n}) AS BIGINT) + 1, {n}) THEN {x} END)"


def ranked(keys: str, x: str, rows: str, p: float) -> str:
    """(keys, x, n): the value at floor(p n) from 0 of each group's ``x`` in order. Equal values are
    counted first, so that only distinct ones are put in order."""
    before = "PARTITION BY {0} ORDER BY {1} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW".format(keys, x)
    return f"""SELECT {keys}, min(CASE WHEN upto > least(CAST(floor({p} * n) AS BIGINT), n - 1) THEN {x} END) AS x, max(n) AS n FROM (
  SELECT {keys}, {x}, sum(c) OVER ({before}) AS upto, sum(c) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, {x}, count(*) AS c FROM {rows} GROUP BY {keys}, {x}) AS h) AS u GROUP BY {keys}"""


def js_round(x: str, digits: int = 0) -> str:
    """Halves go up, also below zero."""
    if not digits:
        return f"CAST(floor({x} + 0.5) AS BIGINT)"
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def band(x: str, zero: float, full: float, top: float = 100.0) -> str:
    """Linear from 0 at ``zero`` to ``top`` at ``full``, clamped."""
    return f"greatest(0e0, least({top}e0, (({x}) - {zero}) / ({full} - {zero}) * {top}e0))"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
