"""SAM files and the other text formats of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
_NUMBERS = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ord, qname ... qual, tags): the alignment lines; tags is a map from TAG to its value. ord grows in input order within a file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord")).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    p = lines.select("ord", F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("p"))
    tags = F.transform(F.slice("p", F.lit(12), F.greatest(F.size("p") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 20).alias("v")))
    columns = [F.get("p", F.lit(i)).cast(_NUMBERS.get(n, "string")).alias(n) for i, n in enumerate(_COLUMNS)]
    return p.select("ord", *columns, F.map_from_entries(F.array_distinct(tags)).alias("tags"))


def read_sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(r"^@[A-Z]{2}(\t|$)"))


def sam_header(chromosomes: DataFrame, order: str = "unsorted", read_group: dict[str, str] | None = None) -> list[str]:
    """Header lines from the chromosome table (one row a sequence)."""
    out = [f"@HD\tVN:1.0\tSO:{order}"]
    for c in chromosomes.orderBy("chrnum").collect():
        out.append(f"@SQ\tSN:{c.chrom}\tLN:{c.length}" + "\ttp:circular" * bool(c.circular))
    return out + (["@RG\t" + "\t".join(f"{k}:{v}" for k, v in read_group.items())] if read_group else [])


def sam_line(tags: str | None = "tags") -> Column:
    """The text of a row; tags are written in the order of their names, whole numbers as i, others as Z."""
    fixed = [F.coalesce(F.col(c).cast("string"), F.lit({"flag": "0", "pos": "0", "mapq": "0", "pnext": "0", "tlen": "0"}.get(c, "*"))) for c in _COLUMNS]
    if tags is None:
        return F.concat_ws("\t", *fixed)
    kind = lambda v: F.when(v.rlike(r"^-?\d+$"), F.lit("i")).otherwise(F.lit("Z"))
    more = F.transform(F.array_sort(F.map_entries(F.coalesce(F.col(tags), F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(":"), kind(e["value"]), F.lit(":"), e["value"]))
    return F.concat_ws("\t", *fixed, more)


def write_split(rows: DataFrame, path: str, code: str = "xo", line: Column | None = None, mode: str = "errorifexists") -> None:
    """Text files in a folder for each output code."""
    rows.select(code, (sam_line() if line is None else line).alias("value")).write.mode(mode).partitionBy(code).text(path)


def failed_reads(reads: DataFrame, fastq: bool = True) -> DataFrame:
    """The records (one text a read end) of reads without a usable place: codes NM and those that end in X."""
    bad = reads.where((F.col("xo") == "NM") | F.col("xo").endswith("X"))
    lines = F.concat(F.lit("@"), "acc", F.lit("\n"), "seq", F.lit("\n+\n"), "qual") if fastq else F.concat(F.lit(">"), "acc", F.lit("\n"), "seq")
    return bad.select("acc", lines.alias("value"))


def m8_line() -> Column:
    """BLAST tabular: acc, chrom, identity in percent, length, mismatches, gap openings, query range, genome range, e-value, bit score."""
    return F.concat_ws("\t", "acc", "chrom", F.format_string("%.1f", F.bround(100 * F.col("identity"), 1)), *(F.col(c).cast("string") for c in ("length", "mism")), F.lit("0"), *(F.col(c).cast("string") for c in ("qstart", "qend", "gstart", "gend")), F.format_string("%.1e", F.col("evalue")), F.format_string("%.1f", F.col("bits")))


def gff3_lines(source: str = "strandline") -> Column:
    """gene, mRNA and exon rows of a transcript row (transcript, gene, chrom, strand, exons: array of structs start, end)."""
    low, high = (F.expr(f"aggregate(exons, {s}, (a, x) -> {f}(a, x.{c}))") for s, f, c in (("9223372036854775807L", "least", "start"), ("0L", "greatest", "end")))
    row = lambda kind, a, b, attrs: F.concat_ws("\t", "chrom", F.lit(source), F.lit(kind), a.cast("string"), b.cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    gene = row("gene", low, high, F.concat(F.lit("ID="), "gene"))
    mrna = row("mRNA", low, high, F.concat(F.lit("ID="), "transcript", F.lit(";Parent="), "gene"))
    exons = F.transform("exons", lambda e, i: row("exon", e["start"], e["end"], F.concat(F.lit("ID="), "transcript", F.lit(".exon"), (i + 1).cast("string"), F.lit(";Parent="), "transcript")))
    return F.concat_ws("\n", gene, mrna, F.array_join(exons, "\n"), F.lit("###"))


def psl_line() -> Column:
    """The 21 columns of PSL from matches, mism, strand, acc, qlength, chrom, clength and blocks (structs qstart, gstart, length; offsets from 0)."""
    first, last = F.element_at("blocks", 1), F.element_at("blocks", -1)
    gaps = lambda c: F.zip_with("blocks", F.slice("blocks", F.lit(2), F.size("blocks")), lambda a, b: b[c] - a[c] - a["length"])
    n_gaps = lambda c: F.size(F.filter(gaps(c), lambda x: x > 0))
    bases = lambda c: F.aggregate(F.filter(gaps(c), lambda x: x > 0), F.lit(0).cast("long"), lambda s, x: s + x)
    listed = lambda c: F.concat(F.array_join(F.transform("blocks", lambda b: b[c].cast("string")), ","), F.lit(","))
    values = ["matches", "mism", F.lit(0), F.lit(0), n_gaps("qstart"), bases("qstart"), n_gaps("gstart"), bases("gstart"), "strand", "acc", "qlength", first["qstart"], last["qstart"] + last["length"], "chrom", "clength", first["gstart"], last["gstart"] + last["length"], F.size("blocks"), listed("length"), listed("qstart"), listed("gstart")]
    return F.concat_ws("\t", *((F.col(v) if isinstance(v, str) else v).cast("string") for v in values))


def coordinate_rows(aligned: DataFrame) -> DataFrame:
    """(acc, qpos, q, gpos, g): a row per column of alignments (acc, qstart, gstart, query, genome; - is a gap)."""
    pairs = F.posexplode(F.zip_with(F.split("query", ""), F.split("genome", ""), lambda a, b: F.struct(a.alias("q"), b.alias("g")))).alias("i", "x")
    before = lambda text, start: F.when(F.substring(F.col(text), F.col("i") + 1, F.lit(1)) != "-", F.col(start) + F.col("i") - F.length(F.regexp_replace(F.substring(F.col(text), F.lit(1), F.col("i") + 1), "[^-]", "")))
    rows = aligned.select("acc", "qstart", "gstart", "query", "genome", pairs)
    return rows.select("acc", before("query", "qstart").alias("qpos"), F.col("x.q").alias("q"), before("genome", "gstart").alias("gpos"), F.col("x.g").alias("g"))


def write_ordered(rows: DataFrame, path: str, value: Column, order: str = "ordinal", header: list[str] = ()) -> None:
    """Text lines in order of a column: files that sort by name hold ranges of it, the header stands in the first."""
    spark = rows.sparkSession
    lines = rows.select(F.col(order).cast("long").alias("_o"), value.alias("value"))
    if header:
        lines = spark.createDataFrame([(-len(header) + i - (1 << 40), h) for i, h in enumerate(header)], "_o long, value string").unionByName(lines)
    lines.orderBy("_o").select("value").write.text(path)
