"""All queries of the ledger engine by name, and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import goals, insights, layout, monthly, normalize, payees, recurring  # noqa: F401  they register relations
from ..sources import adapters  # noqa: F401
from ..streaming import incremental
from .oracles import independent
from .relations import DUCK, RELATIONS, query, statement

#: Relations that are results of their own, by the operator's identifier.
RESULT = re.compile(r"^(ag|wn|ry|cd|rec|fl|so|st|jn|bh|cx|tr|hs|rp|rv|ir|pl|nrm|fn|src)\d*_|^(order_categories|event_days)$")


def names() -> list[str]:
    return [n for n in RELATIONS if RESULT.match(n)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: query(n) for n in names()}
    for module in (payees, goals, layout, recurring, incremental):
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    return {n: statement(n, DUCK) for n in names()} | incremental.ORACLES | layout.ORACLES | recurring.oracles() | independent()
