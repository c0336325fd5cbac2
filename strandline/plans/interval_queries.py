"""Queries on intervals, depth and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coordinates as co
from ..operators import alignments, coverage, intervals
from ..operators.genome import chromosome_table
from .carriers import Tables
from .catalog import query

# Intervals


@query("iv_overlap", "SELECT a.id, count(*) AS n FROM iv a JOIN iv b ON a.div = b.div AND a.low <= b.high AND b.low <= a.high GROUP BY a.id", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.overlap_join(t("iv"), t("iv")).groupBy("id").agg(F.count("*").alias("n"))


@query("iv_overlap_signed", "SELECT a.id, b.id AS other FROM iv a JOIN iv b ON a.div = b.div AND a.sign = b.sign AND a.low <= b.high AND b.low <= a.high", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.overlap_join(t("iv"), t("iv"), ("div", "sign")).select("id", F.col("r_id").alias("other"))


@query("iv_overlap_typed", "SELECT a.id, b.id AS other FROM iv a JOIN iv b ON a.div = b.div AND a.type = b.type AND a.low <= b.high AND b.low <= a.high", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.overlap_join(t("iv"), t("iv"), ("div", "type")).select("id", F.col("r_id").alias("other"))


@query("iv_overlap_typed_signed", "SELECT a.id, b.id AS other FROM iv a JOIN iv b ON a.div = b.div AND a.type = b.type AND a.sign = b.sign AND a.low <= b.high AND b.low <= a.high", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.overlap_join(t("iv"), t("iv"), ("div", "type", "sign")).select("id", F.col("r_id").alias("other"))


@query("iv_exists", "SELECT a.id, a.low, a.high FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE b.div = a.div AND b.type = a.type AND b.id <> a.id AND a.low <= b.high AND b.low <= a.high)", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.overlap_join(t("iv"), t("iv"), ("div", "type"), how="left_semi", condition=F.col("id") != F.col("r_id")).select("id", "low", "high")


@query("iv_exact", "SELECT a.id, b.id AS other FROM days a JOIN days b ON a.div = b.div AND a.type = b.type AND a.low = b.low AND a.high = b.high AND a.sign = b.sign", ("days",))
def _(t: Tables) -> DataFrame:
    return intervals.exact_join(t("days"), t("days"), ("div", "type", "low", "high", "sign")).select("id", F.col("r_id").alias("other"))


@query("iv_one", "SELECT id, other_low, other_high, other FROM (SELECT a.id, b.low AS other_low, b.high AS other_high, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.low, b.high, b.id) AS r FROM iv a JOIN iv b ON a.div = b.div AND a.low <= b.high AND b.low <= a.high) WHERE r = 1", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.first_overlap(t("iv"), t("iv")).select("id", F.col("r_low").alias("other_low"), F.col("r_high").alias("other_high"), F.col("r_id").alias("other"))


@query("iv_label", "SELECT id, label, low, high FROM iv WHERE label IN ('u1', 'u17', 'u42') ", ("iv",))
def _(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("u1",), ("u17",), ("u42",), ("absent",)], "label string")
    return t("iv").join(F.broadcast(wanted), "label").select("id", "label", "low", "high")


_FLANK = "SELECT id, other, rank FROM (SELECT a.id, b.id AS other, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {order}, b.id) AS INTEGER) AS rank FROM iv a JOIN iv b ON a.div = b.div AND {test}) WHERE rank <= 2"


@query("iv_flank_right", _FLANK.format(order="b.low", test="b.low > a.high"), ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.neighbours(t("iv"), t("iv"), 2, "right", ring=64).select("id", F.col("r_id").alias("other"), "rank")


@query("iv_flank_left", _FLANK.format(order="b.high DESC", test="b.high < a.low"), ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.neighbours(t("iv"), t("iv"), 2, "left", ring=64).select("id", F.col("r_id").alias("other"), "rank")


@query("iv_flank_signed", _FLANK.format(order="b.low", test="a.sign = b.sign AND a.type = b.type AND b.low > a.high"), ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.neighbours(t("iv"), t("iv"), 2, "right", ("div", "sign", "type"), ring=512).select("id", F.col("r_id").alias("other"), "rank")


_CHROMS = """chroms AS (SELECT n_nationkey AS chrnum, n_name AS chrom, n_nationkey + 100 AS length,
  coalesce(CAST(sum(n_nationkey + 100) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM nation)"""


def _chromosomes(t: Tables) -> DataFrame:
    return chromosome_table(t("nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("chrom"), (F.col("n_nationkey") + 100).cast("long").alias("length")))


@query("pos_to_chr", f"WITH {_CHROMS} SELECT c_custkey AS id, chrom, pos - \"offset\" AS chrpos FROM (SELECT c_custkey, c_custkey % 2800 + 1 AS pos FROM customer) JOIN chroms ON pos > \"offset\" AND pos <= \"offset\" + length")
def _(t: Tables) -> DataFrame:
    positions = t("customer").selectExpr("c_custkey AS id", "c_custkey % 2800 + 1 AS pos")
    return intervals.locate(positions, _chromosomes(t)).select("id", "chrom", "chrpos")


@query("chr_to_pos", f"WITH {_CHROMS} SELECT c_custkey AS id, \"offset\" + c_custkey % 100 + 1 AS pos FROM customer JOIN chroms ON chrnum = c_nationkey")
def _(t: Tables) -> DataFrame:
    c = _chromosomes(t).select("chrnum", "offset")
    named = t("customer").join(c, F.col("c_nationkey") == F.col("chrnum") - 1)
    return named.select(F.col("c_custkey").alias("id"), (F.col("offset") + F.col("c_custkey") % 100 + 1).alias("pos"))


@query("chromosome_listing", f"WITH {_CHROMS} SELECT chrom, CAST(\"offset\" + 1 AS BIGINT) AS first, CAST(\"offset\" + length AS BIGINT) AS last, CAST(length AS BIGINT) AS length FROM chroms")
def _(t: Tables) -> DataFrame:
    return _chromosomes(t).select("chrom", (F.col("offset") + 1).alias("first"), (F.col("offset") + F.col("length")).alias("last"), "length")


@query("highs_for_low", "SELECT div, high AS position FROM days WHERE low = 100 GROUP BY div, high", ("days",))
def _(t: Tables) -> DataFrame:
    return intervals.endpoints(t("days"), low=100)


@query("lows_for_high", "SELECT div, low AS position FROM days WHERE high = 100 GROUP BY div, low", ("days",))
def _(t: Tables) -> DataFrame:
    return intervals.endpoints(t("days"), high=100)


@query("type_filter", "SELECT id, type FROM iv WHERE type IN ('t1', 't3')", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.by_type(t("iv"), ["t1", "t3", "unknown"]).select("id", "type")


@query("sign_filter", "SELECT id, sign FROM iv WHERE sign = -1", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.by_sign(t("iv"), -1).select("id", "sign")


@query("value_between", "SELECT id, value FROM iv WHERE value BETWEEN 10 AND 20", ("iv",))
def _(t: Tables) -> DataFrame:
    return intervals.by_value(t("iv"), 10, 20).select("id", "value")


@query("value_order", "SELECT id, CAST(row_number() OVER (PARTITION BY div ORDER BY value, id) AS INTEGER) AS place FROM iv", ("iv",))
def _(t: Tables) -> DataFrame:
    return alignments.ranked(t("iv"), [F.col("value"), F.col("id")], "div").select("id", F.col("rank").alias("place"))


@query("intersect_ids", "SELECT id FROM iv WHERE low <= 700 AND high >= 200 INTERSECT SELECT id FROM iv WHERE value >= 30", ("iv",))
def _(t: Tables) -> DataFrame:
    place = t("iv").where(co.overlaps(F.col("low"), F.col("high"), F.lit(200), F.lit(700)))
    return intervals.intersect_ids(place, intervals.by_value(t("iv"), 30))


@query("union_stores", "SELECT id, div, low, high FROM iv WHERE sign = 1 UNION ALL SELECT id, div, low, high FROM days", ("iv", "days"))
def _(t: Tables) -> DataFrame:
    columns = ["id", "div", "low", "high"]
    return intervals.by_sign(t("iv"), 1).select(*columns).unionByName(t("days").select(*columns))


@query("except_ids", "SELECT id FROM iv WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE b.label = iv.label AND b.id < iv.id)", ("iv",))
def _(t: Tables) -> DataFrame:
    firsts = t("iv").groupBy("label").agg(F.min("id").alias("first"))
    return t("iv").join(firsts, "label").where("id = first").select("id")


@query("store_catalog", "SELECT 'div' AS kind, div AS name FROM iv GROUP BY div UNION ALL SELECT 'type', type FROM iv GROUP BY type", ("iv",))
def _(t: Tables) -> DataFrame:
    kinds = [t("iv").select(F.lit(kind).alias("kind"), F.col(kind).alias("name")).distinct() for kind in ("div", "type")]
    return kinds[0].unionByName(kinds[1])


@query("store_extents", "SELECT div, n, coordinates, CAST(coalesce(sum(n) OVER (ORDER BY div ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT div, count(*) AS n, max(high) + 1 AS coordinates FROM iv GROUP BY div)", ("iv",))
def _(t: Tables) -> DataFrame:
    return coverage.extents(t("iv"))


# Depth and tallies

_DEPTH = """WITH ends AS (SELECT div, low AS pos, 1 AS d FROM {s} UNION ALL SELECT div, high{closed}, -1 FROM {s}),
c AS (SELECT div, pos, CAST(sum(d) AS BIGINT) AS d FROM ends GROUP BY div, pos HAVING sum(d) <> 0),
r AS (SELECT div, pos AS start, lead(pos) OVER w - 1 AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM c WINDOW w AS (PARTITION BY div ORDER BY pos))
SELECT div, start, "end", depth FROM r WHERE "end" IS NOT NULL
UNION ALL SELECT div, CAST(1 AS BIGINT), min(pos) - 1, CAST(0 AS BIGINT) FROM c GROUP BY div HAVING min(pos) > 1"""


@query("depth_runs", _DEPTH.format(s="days", closed=""), ("days",))
def _(t: Tables) -> DataFrame:
    return coverage.depth_runs(t("days"))


@query("depth_runs_closed", _DEPTH.format(s="iv", closed=" + 1"), ("iv",))
def _(t: Tables) -> DataFrame:
    return coverage.depth_runs(t("iv"), closed=True)


@query("depth_runs_whole", f"""SELECT div, start, coalesce("end", length) AS "end", depth FROM ({_DEPTH.format(s='iv', closed='').replace('WHERE "end" IS NOT NULL', '')}) d JOIN (SELECT div AS dv, max(high) + 5 AS length FROM iv GROUP BY div) ON dv = div""", ("iv",))
def _(t: Tables) -> DataFrame:
    lengths = t("iv").groupBy("div").agg((F.max("high") + 5).alias("length"))
    return coverage.depth_runs(t("iv"), lengths=lengths)


_TALLY = """WITH lines AS (SELECT conv_id AS id, role AS div, turn AS position, CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '\\d+'), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS count FROM conversations)"""


def _lines(t: Tables) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("div"), F.col("turn").alias("position"), coverage.line_total(F.coalesce("text", F.lit(""))).alias("count"))


@query("tally_lines", f"{_TALLY} SELECT id, div, position, count FROM lines")
def _(t: Tables) -> DataFrame:
    return _lines(t)


_QUANTITY = "SELECT l_orderkey AS id, l_returnflag AS div, CAST(l_linenumber AS BIGINT) AS position, CAST(l_quantity AS BIGINT) AS count FROM lineitem"


def _quantities(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr("l_orderkey AS id", "l_returnflag AS div", "CAST(l_linenumber AS BIGINT) AS position", "CAST(l_quantity AS BIGINT) AS count")


@query("tally_running", f"SELECT id, position, div, count, CAST(coalesce(sum(count) OVER (PARTITION BY id ORDER BY position, div, count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS running_before FROM ({_QUANTITY})")
def _(t: Tables) -> DataFrame:
    return coverage.running_before(_quantities(t), ("position", "div", "count"), by=("id",)).select("id", "position", "div", "count", "running_before")


@query("tally_stats", f"SELECT div, CAST(sum(count) AS BIGINT) AS counts, CAST(3 AS BIGINT) AS width, sum(count) / 3 AS mean FROM ({_QUANTITY}) WHERE position BETWEEN 2 AND 4 GROUP BY div")
def _(t: Tables) -> DataFrame:
    return coverage.tally_statistics(_quantities(t), 2, 4)


@query("tally_geometric", f"SELECT div, round(exp(sum(ln(count + 1)) / 3000) - 1, 6) AS mean FROM ({_QUANTITY}) WHERE position BETWEEN 2 AND 3001 GROUP BY div")
def _(t: Tables) -> DataFrame:
    return coverage.geometric_mean(_quantities(t), 2, 3001).select("div", F.round("mean", 6).alias("mean"))


@query("runlength_expand", "SELECT div, unnest(range(low, high + 1)) AS position, id % 9 AS count FROM iv", ("iv",))
def _(t: Tables) -> DataFrame:
    return coverage.run_length_positions(t("iv").withColumn("label", (F.col("id") % 9).cast("string")))


@query("zero_fill", "WITH have AS (SELECT div, low AS position, count(*) AS count FROM iv GROUP BY div, low) SELECT d.div, p.position, coalesce(have.count, 0) AS count FROM (SELECT DISTINCT div FROM iv) d CROSS JOIN (SELECT unnest(range(0, (SELECT max(high) FROM iv) + 1)) AS position) p LEFT JOIN have ON have.div = d.div AND have.position = p.position", ("iv",))
def _(t: Tables) -> DataFrame:
    have = t("iv").groupBy("div", F.col("low").alias("position")).agg(F.count("*").alias("count"))
    return coverage.zero_fill(have, 0, t("iv").agg(F.max("high")).first()[0])


@query("covered_length", "SELECT div, CAST(count(DISTINCT p) AS BIGINT) AS covered FROM (SELECT div, unnest(range(low, high + 1)) AS p FROM iv) GROUP BY div", ("iv",))
def _(t: Tables) -> DataFrame:
    return coverage.union_length(t("iv"))


@query("snp_blocks", "SELECT id, CAST(sum(new) OVER (PARTITION BY div ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT id, div, low AS position, CASE WHEN low - lag(low) OVER (PARTITION BY div ORDER BY low) < 6 THEN 0 ELSE 1 END AS new FROM iv)", ("iv",))
def _(t: Tables) -> DataFrame:
    return coverage.islands(t("iv").withColumn("position", F.col("low")), 6).select("id", F.col("island").cast("long").alias("island"))


_CHANGE = """WITH s AS (SELECT event_type AS div, event_id AS position, CAST(CAST(floor(abs(value)) AS BIGINT) % 7 >= {step} AS BIGINT) AS hits, CAST(1 AS BIGINT) AS total FROM events),
x AS (SELECT *, sum(hits) OVER w AS x, sum(total) OVER w AS n, min(position) OVER w AS first FROM s WINDOW w AS (PARTITION BY div)),
y AS (SELECT *, sum(hits) OVER o AS xp, sum(total) OVER o AS np FROM x WHERE position > first WINDOW o AS (PARTITION BY div ORDER BY position {order} ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, x - xp AS xf, n - np AS nf, (xp + 12.0::DOUBLE * (x / n)) / (np + 12.0::DOUBLE) AS tp, (x - xp + 12.0::DOUBLE * (x / n)) / (n - np + 12.0::DOUBLE) AS tf FROM y),
r AS (SELECT *, (xp * (1 - tp) * (1 - tp) + (np - xp) * tp * tp) + (xf * (1 - tf) * (1 - tf) + (nf - xf) * tf * tf) AS error FROM t),
b AS (SELECT * FROM r WHERE error > 0 AND tf < tp - 0.1::DOUBLE AND error < x * (n - x) / n QUALIFY row_number() OVER (PARTITION BY div ORDER BY error, position {order}) = 1)
SELECT d.div, b.position AS edge, CAST(coalesce(xf, 0) AS BIGINT) AS hits, CAST(coalesce(nf, 0) AS BIGINT) AS total FROM (SELECT DISTINCT div FROM s) d LEFT JOIN b USING (div)"""


def _matches(t: Tables, step: str) -> DataFrame:
    return t("events").selectExpr("event_type AS div", "event_id AS position", f"CAST(CAST(floor(abs(value)) AS BIGINT) % 7 >= {step} AS BIGINT) AS hits", "CAST(1 AS BIGINT) AS total")


@query("change_point", _CHANGE.format(step="CASE WHEN event_id < 300 THEN 5 ELSE 2 END", order="DESC"))
def _(t: Tables) -> DataFrame:
    return coverage.change_points(_matches(t, "CASE WHEN event_id < 300 THEN 5 ELSE 2 END"))


@query("change_point_right", _CHANGE.format(step="CASE WHEN event_id > 700 THEN 5 ELSE 2 END", order="ASC"))
def _(t: Tables) -> DataFrame:
    return coverage.change_points(_matches(t, "CASE WHEN event_id > 700 THEN 5 ELSE 2 END"), "right")
