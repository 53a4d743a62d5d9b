from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import Ledger, cte
from ..operators import exports
from ..scratch import folder

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a Ledger under a name, with its SQL if there is one."""

    def add(f: Callable[[Ledger], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            ORACLES[name] = cte(sql)
        return f

    return add


def read_back(t: Ledger, rows: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Rows written as workbooks, read cell by cell and put together by the headers in each file's first row; all as texts."""
    path = folder(t.spark)
    exports.write_workbook(rows, path, headers)
    cells = t.spark.read.format("workbook").option("path", path).load()
    names = {(headers or {}).get(c, c): c for c in rows.columns}
    place = {c: i for i, c in enumerate(names, 1)}
    values = [F.max(F.when(F.col("col") == place[h], F.col("text"))).alias(c) for h, c in names.items()]
    rows = cells.groupBy("file", "row").agg(*values)
    # headers must stand where they were written
    right = F.lit(True)
    for h, c in names.items():
        right &= F.col(c).eqNullSafe(F.lit(h))
    entry = F.when(F.col("row") > 1, True).otherwise(F.when(right, False).otherwise(F.raise_error(F.lit("other headers")).cast("boolean")))
    return rows.filter(entry).drop("file", "row")
