"""Streams of queries and of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordinates import parse_range
from ..operators.intervals import BIN


def query_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Lines of range queries from files that arrive in a folder; files bounds what a batch takes in."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files).load(folder).select(F.col("value").alias("query"))


def answer(queries: DataFrame, store: DataFrame, size: int = BIN) -> DataFrame:
    """(query, label, div, low, high): the intervals of a store that each range query meets; a query that is no range is taken as a label.

    Works on streams: without state, each query joins the static store by bins. Queries without an answer give no row.
    """
    q = queries.withColumn("r", parse_range(F.col("query")))
    s = store.select("label", F.coalesce("div", F.lit("")).alias("div"), "low", "high")
    spread = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    ranges = q.where("r IS NOT NULL").withColumn("qbin", F.explode(F.sequence(F.floor(F.col("r.low") / size), F.floor(F.col("r.high") / size))))
    test = (F.col("qbin") == F.col("bin")) & (F.col("r.div") == F.col("div")) & (F.col("r.low") <= F.col("high")) & (F.col("low") <= F.col("r.high"))
    by_place = ranges.join(spread, test & (F.col("qbin") == F.floor(F.greatest("r.low", "low") / size))).select("query", "label", "div", "low", "high")
    by_label = q.where("r IS NULL").join(s, F.col("query") == F.col("label")).select("query", "label", "div", "low", "high")
    return by_place.union(by_label)


def framed(answers: DataFrame) -> DataFrame:
    """One text a query of a batch: # Query, its answers, # End."""
    line = F.concat(F.lit(">"), "label", F.lit(" "), "div", F.lit(":"), F.col("low").cast("string"), F.lit(".."), F.col("high").cast("string"))
    grouped = answers.groupBy("query").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    return grouped.select(F.concat(F.lit("# Query: "), "query", F.lit("\n"), "lines", F.lit("\n# End")).alias("value"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n, total): events by window of event time; rows later than the watermark are dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), by, "n", "total")


def first_seen(events: DataFrame, keys: tuple[str, ...], late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Events without those whose keys came before within the watermark; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", by: str = "user_id") -> DataFrame:
    """(by, start, end, n): runs of events with pauses below gap."""
    grouped = events.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what is there now, as a table in memory: for small results and tests."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
