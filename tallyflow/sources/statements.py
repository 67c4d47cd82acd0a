"""Statement files as lines with places, by a reader of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line has; a reader gives tuples of all but the first.
LINE = ("statement", "page", "block", "block_y", "line", "line_y", "x", "width", "text")
SCHEMA = "statement string, page int, block int, block_y double, line int, line_y double, x double, width double, text string, status string, problem string"

Reader = Callable[[bytes, "str | None"], list[tuple]]


class Locked(Exception):
    """A reader raises it when the password is missing or wrong."""


def lines_of(files: DataFrame, read: Reader, vision: Reader | None = None, least_text: int = 50) -> DataFrame:
    """SRC1, SRC8, SRC10 over (path, content[, password]), as ``spark.read.format("binaryFile")`` gives
    them: the lines with status ``ok``, or ``vision`` where the text reader failed or found fewer than
    ``least_text`` characters (a scanned image). A file that gives no lines gives one row without text,
    ``locked`` (to be tried again with a password; the file stays) or ``failed``, and why. An unreadable
    file fails nothing but itself; null content is ``failed``."""
    rows = files if "password" in files.columns else files.withColumn("password", F.lit(None).cast("string"))

    def one(path: str, content: bytes | None, password: str | None) -> list[tuple]:
        why, found = "no content", []
        if content is not None:
            try:
                found = read(bytes(content), password)
                if sum(len(v[-1] or "") for v in found) >= least_text:
                    return [(path, *v, "ok", None) for v in found]
                why = "too little text"
            except Locked as e:
                return [(path, *[None] * 8, "locked", str(e))]
            except Exception as e:  # whatever a reader raises is its file's own affair
                why = f"{type(e).__name__}: {e}"
            if vision is not None:
                try:
                    found = vision(bytes(content), password)
                    return [(path, *v, "vision", None) for v in found] or [(path, *[None] * 8, "failed", "no lines")]
                except Exception as e:  # the same for the second reader
                    why = f"{why}; {type(e).__name__}: {e}"
        return [(path, *[None] * 8, "failed", why)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content, password in zip(frame["path"], frame["content"], frame["password"], strict=True):
                yield pd.DataFrame(one(path, content, password), columns=[*LINE, "status", "problem"])

    return rows.select("path", "content", "password").mapInPandas(run, SCHEMA)


def details(lines: DataFrame, banks: dict[str, str]) -> DataFrame:
    """SRC9: (statement, bank, last4) of the first page: the bank whose pattern it holds, and the last four
    digits of the first account number, masked or not. Null where there is none."""
    text = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "text"))), lambda v: v["text"]))
    first = lines.filter("page = 1 AND text IS NOT NULL").groupBy("statement").agg(text.alias("words"))
    bank: Column = F.coalesce(*[F.when(F.col("words").rlike(f"(?i){pattern}"), name) for name, pattern in banks.items()], F.lit(None).cast("string"))
    last4 = F.nullif(F.regexp_extract("words", r"(?i)\b(?:account|a/c)\D{0,20}?[0-9xX*]{2,}?([0-9]{4})\b", 1), F.lit(""))
    return first.select("statement", bank.alias("bank"), last4.alias("last4"))


def reloaded(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """SRC13: the stored lines of the statements that a later phase works on."""
    return lines.join(statements.select("statement").distinct(), "statement", "left_semi")
