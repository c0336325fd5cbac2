"""Records of text files: sequences, reads, intervals. Compressed files (.gz, .bz2) are read by their suffix."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coordinates import parse_range
from ..functions.sequence import wrap


def _records(spark: SparkSession, path: str | list[str], mark: str = ">") -> DataFrame:
    """(header, body): records that begin with a mark at a line's start. Files are split at records, so large ones are read in parallel."""
    text = spark.read.text(path, lineSep=f"\n{mark}").select(F.regexp_replace("value", f"^{mark}|\\r", "").alias("r")).where(F.trim("r") != "")
    return text.select(F.trim(F.split("r", "\n", 2)[0]).alias("header"), F.coalesce(F.get(F.split("r", "\n", 2), F.lit(1)), F.lit("")).alias("body"))


def _accession(header: Column) -> list[Column]:
    return [F.regexp_extract(header, r"^(\S*)", 1).alias("acc"), F.nullif(F.regexp_extract(header, r"^\S+\s+(.*)$", 1), F.lit("")).alias("rest")]


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(acc, rest, seq): sequences of any length; what is no letter, * or - in them is left out."""
    return _records(spark, path).select(*_accession(F.col("header")), F.regexp_replace("body", "[^A-Za-z*-]", "").alias("seq"))


def fasta_text(acc: Column, seq: Column, rest: Column | None = None, width: int = 60) -> Column:
    """A record's lines."""
    head = F.concat(F.lit(">"), acc) if rest is None else F.concat_ws(" ", F.concat(F.lit(">"), acc), rest)
    return F.concat_ws("\n", head, F.nullif(wrap(seq, width), F.lit("")))


def read_read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(acc, rest, seq1, seq2, qual1, qual2): short reads, one line an end; after a + line come the qualities, one line an end."""
    r = _records(spark, path).select(*_accession(F.col("header")), F.split(F.regexp_replace("body", r"\n+$", ""), r"\n").alias("l"))
    plus = F.array_position(F.transform("l", lambda x: F.substring(x, 1, 1) == "+"), True).cast("int")
    seqs = F.when(plus > 0, F.slice("l", F.lit(1), F.greatest(plus - 1, F.lit(0)))).otherwise(F.col("l"))
    quals = F.when(plus > 0, F.slice("l", plus + 1, F.size("l")))
    r = r.select("acc", "rest", seqs.alias("s"), quals.alias("q"))
    return r.select("acc", "rest", F.get("s", F.lit(0)).alias("seq1"), F.get("s", F.lit(1)).alias("seq2"), F.get("q", F.lit(0)).alias("qual1"), F.get("q", F.lit(1)).alias("qual2"))


_FASTQ = "path string, block long, place long, head string, seq string, qual string, lines array<string>, tail boolean"


def _fastq_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of a block of lines; the lines before its first and after its last record go on as fragments."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("head", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("lines", pa.list_(pa.string())), ("tail", pa.bool_())])
    key, held, place, synced = None, [], 0, False

    def sync(lines: list[str], block: int) -> int | None:
        """Where the first record starts: an @ line with a + line two further on; None while that can't be told."""
        if block == 0:
            return 0
        for i in range(min(4, len(lines) - 2)):
            if lines[i].startswith("@") and lines[i + 2].startswith("+"):
                return i
        return None if len(lines) < 7 else 0

    def settle(last: bool) -> list[dict]:
        nonlocal held, place, synced
        out = []
        if not synced:
            at = sync(held, key[1])
            if at is None:
                if last and held:
                    out.append({"path": key[0], "block": key[1], "lines": held, "tail": False})
                    held = []
                return out
            if at:
                out.append({"path": key[0], "block": key[1], "lines": held[:at], "tail": False})
            held, synced = held[at:], True
        n = len(held) // 4 * 4
        for i in range(0, n, 4):
            out.append({"path": key[0], "block": key[1], "place": place, "head": held[i], "seq": held[i + 1], "qual": held[i + 3]})
            place += 1
        held = held[n:]
        if last and held:
            out.append({"path": key[0], "block": key[1], "lines": held, "tail": True})
            held = []
        return out

    for batch in batches:
        rows = []
        for path, block, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
            if (path, block) != key:
                if key:
                    rows += settle(True)
                key, held, place, synced = (path, block), [], 0, False
            held.append(value.rstrip("\r"))
        if key:
            rows += settle(False)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if key:
        yield pa.RecordBatch.from_pylist(settle(True), schema=schema)


def read_fastq(spark: SparkSession, path: str | list[str], first_field: int = 0, last_field: int = 0) -> DataFrame:
    """(file, ordinal, acc, seq, qual, filtered): reads in four-line records; acc is the header's fields first_field to last_field.

    Plain files are read in blocks in parallel: each block finds its first record by itself, and records that lie across two
    blocks are put together from the fragments at their borders (seven lines at most). ordinal counts a file's records from 0.
    filtered is true for :Y: headers. An ending /1, /2 or /3 of the name is cut off.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    got = lines.mapInArrow(_fastq_lines, _FASTQ)
    parts = got.where(F.col("lines").isNotNull())
    w = Window.partitionBy("path").orderBy("block", F.col("tail"))  # two fragments a block
    joined = parts.withColumn("next", F.lead("lines").over(w)).withColumn("next_tail", F.lead("tail").over(w))
    across = joined.where("tail").select("path", "block", F.lit(1 << 40).cast("long").alias("place"), F.concat("lines", F.when(~F.col("next_tail"), F.col("next")).otherwise(F.array().cast("array<string>"))).alias("l")).where(F.size("l") >= 4)
    whole = got.where(F.col("lines").isNull()).select("path", "block", "place", "head", "seq", "qual").union(across.select("path", "block", "place", F.col("l")[0], F.col("l")[1], F.col("l")[3]))
    blocks = whole.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    based = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = F.col("base") + F.least(F.col("place"), F.col("n") - 1)
    fields = F.split(F.substring("head", 2, 1 << 20), r"\s+")
    acc = F.regexp_replace(F.array_join(F.slice(fields, first_field + 1, last_field - first_field + 1), " "), r"(/[123]|;1|:0)$", "")
    return whole.join(based, ["path", "block"]).select(F.col("path").alias("file"), number.cast("long").alias("ordinal"), acc.alias("acc"), "seq", "qual", F.col("head").rlike(r"\s[123]:Y:").alias("filtered"))


def pair_fastq(one: DataFrame, two: DataFrame, allow_name_mismatch: bool = False) -> DataFrame:
    """Two read_fastq() tables zipped by ordinal: acc, seq1, qual1, filtered1, seq2, ... Different names at one place are an error."""
    a = one.select("ordinal", "acc", *(F.col(c).alias(f"{c}1") for c in ("seq", "qual", "filtered")))
    b = two.select("ordinal", F.col("acc").alias("acc2"), *(F.col(c).alias(f"{c}2") for c in ("seq", "qual", "filtered")))
    both = a.join(b, "ordinal")
    if not allow_name_mismatch:
        both = both.withColumn("acc", F.when(F.col("acc") == F.col("acc2"), F.col("acc")).otherwise(F.raise_error(F.concat(F.lit("names differ: "), "acc", F.lit(" "), "acc2"))))
    return both.drop("acc2")


def chastity_filter(pairs: DataFrame, mode: str = "off") -> DataFrame:
    """Without the pairs that the sequencer flagged: either end (either), or both ends (both)."""
    f1, f2 = F.coalesce("filtered1", F.lit(False)), F.coalesce("filtered2", F.lit(False))
    return {"off": pairs, "either": pairs.where(~(f1 | f2)), "both": pairs.where(~(f1 & f2))}[mode]


def part(rows: DataFrame, i: int, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The rows whose ordinal leaves i when divided by n."""
    return rows.where(F.pmod(F.col(ordinal), F.lit(n)) == i)


_HEADER = r"^(\S+)\s+(\S+)(?:\s+(\S+))?(?:\s+(.*))?$"


def read_intervals(spark: SparkSession, path: str | list[str], fields: list[str] | None = None) -> DataFrame:
    """(label, div, low, high, sign, type, value, rest, annotation[, fields]) of >label div:a..b [type] [/value=x] [rest] records.

    With fields, line k of an annotation is the value of field k, in a map.
    """
    r = _records(spark, path)
    value = F.regexp_extract("header", r"/value=(\S+)", 1).try_cast("double")
    head = F.regexp_replace("header", r"\s*/value=\S+", "")
    part = [F.regexp_extract(head, _HEADER, i) for i in range(1, 5)]
    x = r.select(part[0].alias("label"), parse_range(part[1]).alias("c"), F.nullif(part[2], F.lit("")).alias("type"), value.alias("value"), F.nullif(part[3], F.lit("")).alias("rest"), F.regexp_replace("body", r"\n$", "").alias("annotation"))
    out = x.select("label", "c.div", "c.low", "c.high", "c.sign", "type", F.when(~F.isnan("value"), F.col("value")).alias("value"), "rest", "annotation")
    if fields:
        lines = F.split("annotation", "\n")
        names = F.array(*map(F.lit, fields))
        n = F.least(F.size(lines), F.lit(len(fields)))
        out = out.withColumn("fields", F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(lines, F.lit(1), n)))
    return out


def read_spaced_intervals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same columns from >label start end [div] [type] headers."""
    r = _records(spark, path)
    f = F.split("header", r"\s+")
    a, b = F.get(f, F.lit(1)).cast("long"), F.get(f, F.lit(2)).cast("long")
    return r.select(f[0].alias("label"), F.coalesce(F.get(f, F.lit(3)), F.lit("")).alias("div"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.signum((b - a).cast("double")).cast("int").alias("sign"), F.get(f, F.lit(4)).alias("type"), F.regexp_replace("body", r"\n$", "").alias("annotation"))


def interval_text(annotation_only: bool = False) -> Column:
    """The record of an interval row, as read_intervals() reads it; reverse intervals are written high..low."""
    a, b = (F.when(F.col("sign") < 0, F.col(x)).otherwise(F.col(y)) for x, y in (("high", "low"), ("low", "high")))
    place = F.concat(F.when(F.coalesce("div", F.lit("")) == "", "").otherwise(F.concat("div", F.lit(":"))), a.cast("string"), F.lit(".."), b.cast("string"))
    value = F.when(F.col("value").isNotNull(), F.concat(F.lit("/value="), F.col("value").cast("string")))
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("label")), place, "type", value, "rest")
    note = F.nullif(F.col("annotation"), F.lit(""))
    return F.coalesce(note, F.lit("")) if annotation_only else F.concat_ws("\n", head, note)


def write_store(intervals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An interval store: Parquet by div, in order of low, so that footers prune both by place."""
    intervals.repartition("div").sortWithinPartitions("div", "low").write.mode(mode).partitionBy("div").parquet(path)


def read_store(spark: SparkSession, path: str, div: str | None = None) -> DataFrame:
    """All divs of a store, or one: only its folder is read."""
    store = spark.read.parquet(path)
    return store if div is None else store.where(F.col("div") == div)
