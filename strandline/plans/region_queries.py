"""Queries on filters, pairings and annotations, and on the rules of the variant and gene-model sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import alignments, genome, regions
from ..sources import sam, tables
from .carriers import Tables
from .catalog import query
from .interval_queries import _CHROMS, _chromosomes

# Regions


@query("boundary_counts", "SELECT div, position, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(1 - s) AS BIGINT) AS ends FROM (SELECT div, low AS position, 1 AS s FROM days UNION ALL SELECT div, high, 0 FROM days) GROUP BY div, position", ("days",))
def _(t: Tables) -> DataFrame:
    return regions.boundary_counts(t("days"))


_POINTS = "SELECT div, low AS position, CAST(floor(abs(value)) AS BIGINT) AS count FROM iv"


@query("evidence_sum", f"SELECT a.id, CAST(coalesce(sum(p.count), 0) AS BIGINT) AS support FROM iv a LEFT JOIN ({_POINTS}) p ON p.div = a.div AND p.position BETWEEN a.low AND a.high GROUP BY a.id", ("iv",))
def _(t: Tables) -> DataFrame:
    return regions.evidence(t("iv"), t("iv").selectExpr("div", "low AS position", "CAST(floor(abs(value)) AS BIGINT) AS count"))


@query("exception_counts", "SELECT type AS exception, count(*) AS n, type IN ('t1', 't4') AS excluded FROM iv GROUP BY type", ("iv",))
def _(t: Tables) -> DataFrame:
    return regions.exception_counts(t("iv"), ("t1", "t4"), "type")


@query("chrom_subset", "SELECT id, low, high FROM days WHERE div = 'A' AND low >= 10 AND high <= 900", ("days",))
def _(t: Tables) -> DataFrame:
    return regions.within(t("days"), "A", 10, 900).select("id", "low", "high")


_SHARES = "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity / 50 AS coverage, 1 - l_discount AS identity FROM lineitem"


@query("passes_filter", f"SELECT id, line FROM ({_SHARES}) WHERE coverage >= 0.3::DOUBLE AND identity >= 0.955::DOUBLE")
def _(t: Tables) -> DataFrame:
    rows = t("lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "l_quantity / 50 AS coverage", "1 - l_discount AS identity")
    return regions.passing(rows, 0.3, 0.955).select("id", "line")


@query("low_count_regions", "SELECT read, hit, pos FROM (SELECT *, max(matches) OVER (PARTITION BY read) AS best FROM hits) WHERE best >= 0.1 * 300 AND matches > 0.25 * best", ("hits",))
def _(t: Tables) -> DataFrame:
    rows = t("hits").withColumn("n_covered", F.col("matches")).withColumn("length", F.lit(300))
    return regions.well_covered(rows).select("read", "hit", "pos")


_ENDS = "ends AS (SELECT l_suppkey AS read, l_returnflag AS chrom, CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand, l_partkey AS pos, l_orderkey % 100 AS qpos, l_linenumber AS line FROM lineitem)"
_PAIRED = f"""WITH {_ENDS}, p AS (SELECT a.read, a.chrom, a.strand, a.pos AS pos5, b.pos AS pos3, a.qpos AS qpos5, b.qpos AS qpos3, CASE a.strand WHEN '-' THEN a.pos - b.pos ELSE b.pos - a.pos END AS span
  FROM ends a JOIN ends b ON a.read = b.read AND a.chrom = b.chrom AND a.strand = b.strand AND a.line = 1 AND b.line = 2 AND b.qpos >= a.qpos WHERE CASE a.strand WHEN '-' THEN a.pos - b.pos ELSE b.pos - a.pos END BETWEEN 0 AND 40)"""


def _paired(t: Tables) -> DataFrame:
    ends = t("lineitem").selectExpr("l_suppkey AS read", "l_returnflag AS chrom", "CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand", "l_partkey AS pos", "l_orderkey % 100 AS qpos", "l_linenumber AS line")
    return regions.pair_matches(ends.where("line = 1"), ends.where("line = 2"), 40)


@query("match_pairs", f"{_PAIRED} SELECT * FROM p")
def _(t: Tables) -> DataFrame:
    return _paired(t)


@query("promiscuity_cut", f"{_PAIRED} SELECT read, chrom, strand, pos5, qpos5, n, spans FROM (SELECT read, chrom, strand, pos5, qpos5, count(*) AS n, CAST(sum(span) AS BIGINT) AS spans FROM (SELECT *, row_number() OVER (PARTITION BY read, chrom, strand, pos5, qpos5 ORDER BY span, pos3, qpos3) AS r FROM p) WHERE r <= 4 GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    return regions.promiscuity_cut(_paired(t)).groupBy("read", "chrom", "strand", "pos5", "qpos5").agg(F.count("*").alias("n"), F.sum("span").alias("spans"))


_SITES = "SELECT event_type AS chrom, CASE event_id % 2 WHEN 0 THEN '+' ELSE '-' END AS strand, event_id AS pos, user_id % 3 AS kind FROM events"


@query("splice_pairs", f"WITH s AS ({_SITES}), p AS (SELECT d.chrom, d.strand, d.pos AS donor, a.pos AS acceptor, CASE d.strand WHEN '-' THEN d.pos - a.pos ELSE a.pos - d.pos END AS length FROM s d JOIN s a ON d.chrom = a.chrom AND d.strand = a.strand AND d.kind = 0 AND a.kind = 1) SELECT * FROM p WHERE length BETWEEN 1 AND 60")
def _(t: Tables) -> DataFrame:
    s = t("events").selectExpr("event_type AS chrom", "CASE event_id % 2 WHEN 0 THEN '+' ELSE '-' END AS strand", "event_id AS pos", "user_id % 3 AS kind")
    return regions.pair_splice_sites(s.where("kind = 0"), s.where("kind = 1"), 60)


@query("reads_over_sites", "SELECT id, low, high FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE b.div = a.div AND b.sign = -1 AND b.low BETWEEN a.low AND a.high)", ("iv",))
def _(t: Tables) -> DataFrame:
    return regions.reads_over_sites(t("iv"), t("iv").where("sign = -1").selectExpr("div", "low AS position")).select("id", "low", "high")


@query("cross_table", f"WITH {_CHROMS} SELECT CAST(chrnum + 1 AS INTEGER) AS chrnum, chrom, CAST(coalesce(d.n, -1) AS INTEGER) AS divno FROM chroms LEFT JOIN (SELECT n_name, n_regionkey * 100 + n_nationkey AS n FROM nation WHERE n_regionkey < 3) d ON n_name = chrom")
def _(t: Tables) -> DataFrame:
    return regions.cross_table(_chromosomes(t), t("nation").where("n_regionkey < 3").selectExpr("n_regionkey * 100 + n_nationkey AS divno", "n_name AS div"))


@query("gene_overlap", """SELECT id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'known_multiexon' ELSE 'known' END AS gene_class FROM iv LEFT JOIN (SELECT id, max(n) AS n FROM (
  SELECT a.id, b.type, count(DISTINCT (b.low, b.high)) AS n FROM iv a JOIN iv b ON a.div = b.div AND b.sign = 1 AND b.value > 10 AND a.low <= b.high AND b.low <= a.high GROUP BY a.id, b.type) GROUP BY id) USING (id)""", ("iv",))
def _(t: Tables) -> DataFrame:
    exons = t("iv").where("sign = 1 AND value > 10").selectExpr("type AS gene", "div", "low", "high")
    return regions.gene_overlap(t("iv"), exons)


@query("merged_positions", "SELECT type AS kmer, low AS position FROM iv WHERE sign = 1 UNION SELECT type, low FROM iv WHERE value > 20 UNION SELECT type, high FROM iv", ("iv",))
def _(t: Tables) -> DataFrame:
    place = lambda rows, c: rows.selectExpr("type AS kmer", f"{c} AS position")
    return regions.merged_positions(place(t("iv").where("sign = 1"), "low"), place(t("iv").where("value > 20"), "low"), place(t("iv"), "high"))


@query("monotone_bounds", "SELECT id, max(low) OVER (PARTITION BY label ORDER BY id ROWS UNBOUNDED PRECEDING) AS floor, min(high) OVER (PARTITION BY label ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ceiling FROM iv", ("iv",))
def _(t: Tables) -> DataFrame:
    return regions.monotone_bounds(t("iv"), ("label",), "id").select("id", "floor", "ceiling")


@query("label_order", "SELECT id, CAST(row_number() OVER (PARTITION BY div ORDER BY label, id) AS INTEGER) AS place FROM iv", ("iv",))
def _(t: Tables) -> DataFrame:
    return alignments.ranked(t("iv"), [F.col("label"), F.col("id")], "div").select("id", F.col("rank").alias("place"))


@query("fai_listing", f"WITH {_CHROMS} SELECT CAST(chrnum + 1 AS INTEGER) AS chrnum, chrom || chr(9) || length AS line FROM chroms")
def _(t: Tables) -> DataFrame:
    return regions.fai_lines(_chromosomes(t))


@query("clip_overlap", """SELECT id, line, b AS overlap, CAST(floor(b / 2) AS BIGINT) AS clip1, CAST(b - floor(b / 2) AS BIGINT) AS clip2 FROM (
  SELECT l_orderkey AS id, l_linenumber AS line, greatest(least(l_partkey + 75, l_suppkey * 20 + 80) - greatest(l_partkey, l_suppkey * 20) + 1, 0) AS b FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    x = regions.clip_overlap(F.col("l_partkey"), F.col("l_partkey") + 75, F.col("l_suppkey") * 20, F.col("l_suppkey") * 20 + 80)
    return t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), x.alias("x")).select("id", "line", "x.*")


# Sequences


@query("trim_bounds", "SELECT id, CAST(length(s) - length(ltrim(s, 'N')) AS INTEGER) AS trim_start, CAST(length(s) - length(ltrim(s, 'N')) + length(trim(s, 'N')) AS INTEGER) AS trim_end FROM (SELECT id, translate(substring(seq, 1, 60), 'CT', 'NN') AS s FROM seqs)", ("seqs",))
def _(t: Tables) -> DataFrame:
    s = F.translate(F.substring("seq", 1, 60), "CT", "NN")
    return t("seqs").select("id", regions.trim_bounds(s).alias("x")).select("id", "x.*")


_CODON_OF = "coalesce(MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in sq.DEGENERATE.items()) + "}[c], 'NNN')"


@query("back_translate", f"SELECT p_partkey AS id, list_aggregate(list_transform(string_split(upper(p_name), ''), lambda c: {_CODON_OF}), 'string_agg', '') AS seq FROM part")
def _(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), sq.back_translate(F.col("p_name")).alias("seq"))


@query("amino_changes", """SELECT p_partkey AS id, coalesce(list_aggregate(list_filter(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: CASE WHEN substring(a, i, 1) <> substring(b, i, 1) THEN
  (CASE WHEN i > length(a) THEN '-' ELSE substring(a, i, 1) END) || i || (CASE WHEN i > length(b) THEN '-' ELSE substring(b, i, 1) END) END), lambda x: x IS NOT NULL), 'string_agg', ','), '') AS changes
  FROM (SELECT p_partkey, p_name AS a, translate(p_name, 'ae', 'eo') || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS b FROM part)""")
def _(t: Tables) -> DataFrame:
    other = F.concat(F.translate("p_name", "ae", "eo"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""))
    return t("part").select(F.col("p_partkey").alias("id"), sq.amino_changes(F.col("p_name"), other).alias("changes"))


_THREE = "(SELECT id, substring(seq, 1, length(seq) - 2) AS q, substring(seq, 2, length(seq) - 2) AS g, substring(seq, 3) AS a FROM seqs WHERE length(seq) > 2)"


@query("tolerant_mismatches", f"SELECT id, CAST(len(list_filter(range(1, length(q) + 1), lambda i: q[i] <> g[i] AND q[i] <> a[i])) AS INTEGER) AS mism, CAST(len(list_filter(range(1, length(q) + 1), lambda i: q[i] <> g[i] AND q[i] = a[i])) AS INTEGER) AS known FROM {_THREE}", ("seqs",))
def _(t: Tables) -> DataFrame:
    rows = t("seqs").where(F.length("seq") > 2)
    x = sq.tolerant_mismatches(F.expr("substring(seq, 1, length(seq) - 2)"), F.expr("substring(seq, 2, length(seq) - 2)"), F.expr("substring(seq, 3)"))
    return rows.select("id", x.alias("x")).select("id", "x.*")


@query("pair_counters", """SELECT id, len(list_filter(p, lambda i: q[i] = g[i] AND q[i] NOT IN ('-', 'N')))::INTEGER AS matches, len(list_filter(p, lambda i: q[i] <> g[i] AND q[i] NOT IN ('-', 'N') AND g[i] NOT IN ('-', 'N')))::INTEGER AS mismatches,
  len(list_filter(p, lambda i: q[i] <> '-' AND g[i] <> '-' AND (q[i] = 'N' OR g[i] = 'N')))::INTEGER AS unknowns, len(regexp_extract_all(q, '-+'))::INTEGER AS qopens, len(list_filter(p, lambda i: q[i] = '-'))::INTEGER AS qindels,
  len(regexp_extract_all(g, '-+'))::INTEGER AS topens, len(list_filter(p, lambda i: g[i] = '-'))::INTEGER AS tindels
  FROM (SELECT id, range(1, length(seq)) AS p, replace(replace(substring(seq, 1, length(seq) - 1), 'GA', '--'), 'TT', 'TN') AS q, replace(substring(seq, 2), 'TA', '--') AS g FROM seqs WHERE length(seq) > 1)""", ("seqs",))
def _(t: Tables) -> DataFrame:
    q = F.expr("replace(replace(substring(seq, 1, length(seq) - 1), 'GA', '--'), 'TT', 'TN')")
    return t("seqs").where(F.length("seq") > 1).select("id", sq.pair_counters(q, F.expr("replace(substring(seq, 2), 'TA', '--')")).alias("x")).select("id", "x.*")


@query("canonical_introns", "SELECT id FROM (SELECT id, substring(seq, 1, 2) AS d, right(seq, 2) AS a FROM seqs) WHERE (d = 'GT' AND a = 'AG') OR (d = 'GC' AND a = 'AG') OR (d = 'AT' AND a = 'AC') OR (d = 'CT' AND a IN ('AC', 'GC')) OR (d = 'GT' AND a = 'AT')", ("seqs",))
def _(t: Tables) -> DataFrame:
    return t("seqs").where(sq.intron_class(F.substring("seq", 1, 2), F.right("seq", F.lit(2))) != "none").select("id")


_RANGES = "SELECT id, id AS chrom, CAST(3 + id % 7 AS BIGINT) AS low, CAST(3 + id % 7 + id % 90 AS BIGINT) AS high, CASE id % 2 WHEN 0 THEN 1 ELSE -1 END AS sign FROM seqs"


@query("fetch_ranges", f"SELECT r.id, CASE WHEN length(seq) >= high THEN CASE WHEN sign < 0 THEN translate(reverse(substring(seq, low, high - low + 1)), 'ACGT', 'TGCA') ELSE substring(seq, low, high - low + 1) END END AS seq FROM ({_RANGES}) r JOIN seqs USING (id)", ("seqs",))
def _(t: Tables) -> DataFrame:
    rows = t("seqs").withColumnRenamed("id", "chrom")
    ranges = t("seqs").selectExpr("id", "id AS chrom", "CAST(3 + id % 7 AS BIGINT) AS low", "CAST(3 + id % 7 + id % 90 AS BIGINT) AS high", "CASE id % 2 WHEN 0 THEN 1 ELSE -1 END AS sign")
    return genome.fetch(ranges, genome.chunks(rows, 64), 64).select("id", "seq")


# Variants, gene models, reads

_VCF = "SELECT p_partkey AS id, p_brand AS chrom, p_size AS pos, substring('ACGT', 1 + p_size % 4, 1) AS ref, substring('ACGTN', 1 + p_partkey % 5, 1 + CAST(p_partkey % 11 = 0 AS INTEGER)) AS alt, 'dbSNPBuildID=' || (100 + p_size) || CASE p_partkey % 4 WHEN 0 THEN ';VLD' WHEN 1 THEN ';GNO' WHEN 2 THEN ';SLO;GNO' ELSE '' END AS info FROM part"


@query("vcf_rules", f"SELECT id AS rsid, chrom, CAST(pos AS BIGINT) AS pos, least(ref, alt) || greatest(ref, alt) AS alleles FROM ({_VCF}) WHERE alt IN ('A', 'C', 'G', 'T') AND ref <> alt AND pos + 100 <= 140 AND (id % 4 IN (0, 2, 3))")
def _(t: Tables) -> DataFrame:
    info = F.concat(F.lit("dbSNPBuildID="), (F.col("p_size") + 100).cast("string"), F.expr("CASE p_partkey % 4 WHEN 0 THEN ';VLD' WHEN 1 THEN ';GNO' WHEN 2 THEN ';SLO;GNO' ELSE '' END"))
    rows = t("part").selectExpr("p_partkey AS id", "p_brand AS chrom", "p_size AS pos", "substring('ACGT', 1 + p_size % 4, 1) AS ref", "substring('ACGTN', CAST(1 + p_partkey % 5 AS INT), 1 + CAST(p_partkey % 11 = 0 AS INT)) AS alt", "p_size", "p_partkey")
    return tables.vcf_rules(rows.withColumn("info", info), 140)


@query("dbsnp_rules", """SELECT p_partkey AS rsid, p_brand AS chrom, p_size AS pos, least(a, b) || greatest(a, b) AS alleles FROM (SELECT *, substring('ACGT', 1 + p_size % 4, 1) AS a, substring('GTAC', 1 + p_size % 4, 1) AS b FROM part)
  WHERE p_partkey % 3 <> 0 AND p_size % 3 + 1 <= 2 AND p_partkey % 7 <> 1 AND p_partkey % 10 <> 5""")
def _(t: Tables) -> DataFrame:
    rows = t("part").selectExpr("p_partkey AS rsid", "p_brand AS chrom", "p_size AS pos", "CASE WHEN p_partkey % 3 = 0 THEN 'in-del' ELSE 'single' END AS class", "p_size % 3 + 1 AS weight",
        "concat(substring('ACGT', 1 + p_size % 4, 1), '/', substring('GTAC', 1 + p_size % 4, 1), CASE WHEN p_partkey % 10 = 5 THEN '/-' ELSE '' END) AS observed")
    exceptions = t("part").where("p_partkey % 7 < 2").selectExpr("p_partkey AS rsid", "CASE p_partkey % 7 WHEN 1 THEN 'MultipleAlignments' ELSE 'ObservedMismatch' END AS exception")
    return tables.dbsnp_rules(rows, exceptions, 2, ("MultipleAlignments",))


_EXONS = "exons AS (SELECT 'tr' || l_orderkey AS transcript, 'g' || l_orderkey % 50 AS gene, 'chr' || l_orderkey % 9 AS chrom, CASE l_orderkey % 2 WHEN 0 THEN '+' ELSE '-' END AS strand, min(l_linenumber) * 1000 + min(l_orderkey) % 100 AS start, min(l_linenumber) * 1000 + min(l_orderkey) % 100 + 200 AS \"end\" FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _exons(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.selectExpr("concat('tr', l_orderkey) AS transcript", "concat('g', l_orderkey % 50) AS gene", "concat('chr', l_orderkey % 9) AS chrom", "CASE l_orderkey % 2 WHEN 0 THEN '+' ELSE '-' END AS strand",
        "CAST(l_linenumber * 1000 + l_orderkey % 100 AS BIGINT) AS start", "CAST(l_linenumber * 1000 + l_orderkey % 100 + 200 AS BIGINT) AS end")


_GAPS = f"""{_EXONS}, w AS (SELECT *, lead(start) OVER o AS next, row_number() OVER o AS i, count(*) OVER (PARTITION BY transcript) - 1 AS n FROM exons WINDOW o AS (PARTITION BY transcript ORDER BY start)),
gaps AS (SELECT transcript, chrom, strand, CAST(CASE strand WHEN '-' THEN n - i + 1 ELSE i END AS INTEGER) AS number, CAST(n AS INTEGER) AS n, CASE strand WHEN '-' THEN next ELSE "end" END AS donor, CASE strand WHEN '-' THEN "end" ELSE next END AS acceptor, next - "end" - 1 AS length FROM w WHERE next > "end" + 1)"""


@query("introns", f"WITH {_GAPS} SELECT transcript || '.intron' || number || '/' || n AS label, * FROM gaps")
def _(t: Tables) -> DataFrame:
    return tables.introns(_exons(t))


@query("splice_sites", f"""WITH {_GAPS}, s AS (SELECT *, CASE strand WHEN '-' THEN -1 ELSE 1 END AS step FROM gaps)
SELECT transcript || '.exon' || number || '/' || (n + 1) AS label, chrom, donor AS pos1, donor + step AS pos2, 'donor' AS kind, length AS dist FROM s
UNION ALL SELECT transcript || '.exon' || (number + 1) || '/' || (n + 1), chrom, acceptor - step, acceptor, 'acceptor', length FROM s""")
def _(t: Tables) -> DataFrame:
    return tables.splice_sites(_exons(t))


@query("gene_map", f"""WITH {_EXONS}, x AS (SELECT transcript, gene, chrom, strand, list(CASE strand WHEN '-' THEN "end" || ' ' || start ELSE start || ' ' || "end" END ORDER BY CASE strand WHEN '-' THEN -start ELSE start END) AS lines,
  CASE strand WHEN '-' THEN max("end") ELSE min(start) END AS a, CASE strand WHEN '-' THEN min(start) ELSE max("end") END AS b FROM exons GROUP BY transcript, gene, chrom, strand)
SELECT transcript, '>' || transcript || ' ' || chrom || ':' || a || '..' || b || chr(10) || gene || chr(10) || array_to_string(lines, chr(10)) AS record FROM x""")
def _(t: Tables) -> DataFrame:
    return tables.gene_map(_exons(t))


@query("segment_counts", f"WITH {_EXONS} SELECT transcript, CAST(sum(CASE WHEN start > before + 1 OR before IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS segments FROM (SELECT transcript, start, max(\"end\") OVER (PARTITION BY transcript ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM exons) GROUP BY transcript")
def _(t: Tables) -> DataFrame:
    return regions.segment_counts(_exons(t))


@query("m8_lines", """SELECT l_orderkey AS id, l_linenumber AS line, 'r' || l_orderkey || chr(9) || 'chr' || l_suppkey || chr(9) || printf('%.1f', 100 * (CAST(floor(l_quantity) AS DOUBLE) / 64)) || chr(9) || CAST(floor(l_quantity) AS BIGINT) || chr(9) || l_linenumber || chr(9) || 0 || chr(9) || 1 || chr(9) || CAST(floor(l_quantity) AS BIGINT)
  || chr(9) || l_partkey || chr(9) || (l_partkey + 49) || chr(9) || printf('%.1e', CAST(l_linenumber AS DOUBLE) / 10) || chr(9) || printf('%.1f', floor(l_quantity) / 2) AS record FROM lineitem""")
def _(t: Tables) -> DataFrame:
    rows = t("lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "concat('r', l_orderkey) AS acc", "concat('chr', l_suppkey) AS chrom", "floor(l_quantity) / 64.0D AS identity", "floor(l_quantity) AS length", "l_linenumber AS mism",
        "1 AS qstart", "floor(l_quantity) AS qend", "l_partkey AS gstart", "l_partkey + 49 AS gend", "l_linenumber / 10.0D AS evalue", "floor(l_quantity) / 2.0D AS bits")
    return rows.select("id", "line", sam.m8_line().alias("record"))


@query("mates", "SELECT a.l_orderkey AS read, a.ord, b.ord AS mate FROM (SELECT *, l_orderkey * 8 + l_linenumber AS ord FROM lineitem WHERE l_linenumber = 1) a LEFT JOIN (SELECT *, l_orderkey * 8 + l_linenumber AS ord FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)")
def _(t: Tables) -> DataFrame:
    rows = t("lineitem").where("l_linenumber <= 2").selectExpr("l_orderkey AS qname", "l_orderkey * 8 + l_linenumber AS ord", "CASE l_linenumber WHEN 1 THEN 65 ELSE 129 END AS flag")
    return alignments.mates(rows).select(F.col("qname").alias("read"), "ord", F.col("m_ord").alias("mate"))
