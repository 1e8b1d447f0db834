"""Named queries: a Spark callable and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.plans import views
from weftlog.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: Sequence[str] = ()):
    """Register `fn(spark, sf_dir)`; `ctes` names the views of `views.SQL` the SQL reads."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(ctes, sql)
        return fn

    return register


# Both sides round the same way. The nudge keeps finite decimals such as 1/128 off
# the rounding border, where a last-bit difference would flip the sixth digit.
def r6(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(1e-9), 6)


def s6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def joined(col: Column | str) -> Column:
    """Array as text, so that both engines compare it the same way."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
