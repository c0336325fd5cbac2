"""Interval, sequence, read and alignment tables derived from the star schema, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a directory, and the derived ones as SQL over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in DERIVED:
            source, spark_sql, _ = DERIVED[name]
            return self(source).selectExpr(*spark_sql)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _same(source: str, *columns: str) -> tuple[str, list[str], str]:
    """Columns that read the same in both dialects."""
    return source, list(columns), f"SELECT {', '.join(columns)} FROM {source}"


DERIVED = {
    # a user action as an interval on an axis of event numbers
    "iv": _same(
        "events", "event_id AS id", "event_type AS div", "event_id AS low", "event_id + CAST(floor(abs(value)) AS BIGINT) % 20 AS high",
        "CASE WHEN CAST(floor(abs(value)) AS BIGINT) % 20 = 0 THEN 0 WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign", "concat('t', CAST(user_id % 5 AS STRING)) AS type",
        "concat('u', CAST(user_id AS STRING)) AS label", "value",
    ),
    # a line item as an interval of days
    "days": (
        "lineitem",
        ["l_orderkey * 8 + l_linenumber AS id", "l_returnflag AS div", "CAST(datediff(l_shipdate, DATE'1995-01-01') AS BIGINT) AS low", "CAST(datediff(l_shipdate, DATE'1995-01-01') AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS high", "CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END AS sign", "CAST(l_linenumber AS STRING) AS type"],
        "SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS div, CAST(date_diff('day', DATE '1995-01-01', l_shipdate) AS BIGINT) AS low, CAST(date_diff('day', DATE '1995-01-01', l_shipdate) AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS high, CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END AS sign, CAST(l_linenumber AS VARCHAR) AS type FROM lineitem",
    ),
    # letters of a text that are bases, as a sequence
    "seqs": (
        "documents",
        ["doc_id AS id", "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '') AS seq"],
        "SELECT doc_id AS id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents",
    ),
    # a line item as a hit of the read that its order is
    "hits": _same("lineitem", "l_orderkey AS read", "l_linenumber AS hit", "l_partkey AS pos", "CAST(l_quantity AS BIGINT) AS matches", "CAST(l_linenumber AS BIGINT) AS mism", "CAST(l_quantity AS BIGINT) - 3 * l_linenumber AS score"),
}


def with_sql(*names: str) -> str:
    """A WITH clause of derived tables."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n][2].replace(' STRING)', ' VARCHAR)')})" for n in names)
