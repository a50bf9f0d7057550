"""One query text for two engines.

A query is written once, with the few functions whose names differ as macros.
Spark reads table names as DataFrames of the given folder, so nothing is
registered in the session; the other text runs on any SQL engine that has the
tables as views, and is what results are checked against.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Macro: (Spark, DuckDB); $1 and $2 are its arguments.
MACROS = {
    "PCT": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "SECS": ("(unix_micros(cast($1 AS timestamp)) / 1000000.0D)", "(epoch_us($1) / 1000000.0::DOUBLE)"),
    "HALF_EVEN": ("bround($1, $2)", "round_even($1, $2)"),
    "JOINED": ("array_join($1, ',')", "array_to_string($1, ',')"),
    "COMPACT": ("filter(array($1), x -> x IS NOT NULL)", "list_filter([$1], lambda x: x IS NOT NULL)"),
    "SIZE": ("size($1)", "len($1)"),
    "SHA": ("sha2($1, 256)", "sha256($1)"),
    "MATCHES": ("rlike($1, $2)", "regexp_matches($1, $2)"),
    "LONG": ("cast($1 AS bigint)", "cast($1 AS bigint)"),
    "LAST_SEEN": ("last_value($1, true)", "last_value($1 IGNORE NULLS)"),
    "DBL": ("cast($1 AS double)", "cast($1 AS double)"),
    # A quotient as IEEE 754 has it: NaN or infinite over a 0, where Spark's own division raises an error.
    "RATIO": ("coalesce(try_divide($1, $2), CASE WHEN $2 = 0 THEN $1 * cast('Infinity' AS double) END)", "$1 / $2"),
    "TEXT": ("cast($1 AS string)", "cast($1 AS varchar)"),
}


def _expand(sql: str, which: int) -> str:
    """Replaces macros, innermost first."""
    pattern = re.compile(r"\b(" + "|".join(MACROS) + r")\(")
    while found := list(pattern.finditer(sql)):
        m, depth, at, parts = found[-1], 1, found[-1].end(), [""]
        while depth:
            c = sql[at]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1 and m[1] not in ("COMPACT",):
                parts.append("")
            elif depth:
                parts[-1] += c
            at += 1
        body = MACROS[m[1]][which]
        for k, x in enumerate(parts, 1):
            body = body.replace(f"${k}", x.strip())
        sql = sql[: m.start()] + body + sql[at:]
    return sql


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", sql, re.I)]


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query over a folder's tables."""
    text, used = _expand(sql, 0), tables_of(sql)
    text = re.sub(r"[{}]", lambda m: m[0] * 2, text)
    for t in used:
        text = re.sub(rf"\b((?:FROM|JOIN|,)\s+){t}\b", rf"\1{{{t}}}", text, flags=re.I)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run


def oracle(sql: str) -> str:
    return _expand(sql, 1)


def both(queries: dict[str, str]) -> tuple[dict[str, Callable], dict[str, str]]:
    return {k: spark_query(v) for k, v in queries.items()}, {k: oracle(v) for k, v in queries.items()}
