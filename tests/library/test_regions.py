"""Filters, pairings and summaries where the registered queries do not reach: nulls, ties, strands and long sequences."""

import time

from pyspark.sql import functions as F
from strandline.functions import sequence as sq
from strandline.operators import coverage, intervals, kmers, regions


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_semi_join_keeps_equal_rows_and_maps(spark):
    left = spark.sql("SELECT 1 AS id, 'a' AS div, 5L AS low, 200L AS high, map('k', 'v') AS attrs UNION ALL SELECT 1, 'a', 5L, 200L, map('k', 'v') UNION ALL SELECT 2, 'b', 1L, 2L, map('k', 'v')")
    right = spark.createDataFrame([(7, "a", 60, 190), (8, "a", 100, 101)], "id int, div string, low long, high long")
    assert rows(intervals.overlap_join(left, right, how="left_semi"), "id", "high") == [(1, 200), (1, 200)]


def brute_change(scores, right):
    n, x = len(scores), sum(scores)
    rate, edge, best = x / n, None, x * (n - x) / n
    for pos in range(1, n) if right else range(n - 1, 0, -1):
        past = scores[1 : pos + 1] if right else scores[pos:]
        xp, m = sum(past), len(past)
        tp, tf = (xp + 12 * rate) / (m + 12), (x - xp + 12 * rate) / (n - m + 12)
        error = xp * (1 - tp) ** 2 + (m - xp) * tp**2 + (x - xp) * (1 - tf) ** 2 + (n - m - x + xp) * tf**2
        if error > 0 and tf < tp - 0.1 and error < best - 1e-12:
            edge, best = (pos, x - xp, n - m), error
    return edge or (None, 0, 0)


def test_change_points(spark):
    series = {"worse left": [0, 1] * 10 + [1] * 40, "worse right": [1] * 30 + [0] * 20, "even": [1, 0] * 30, "all": [1] * 9, "one": [1]}
    frame = spark.createDataFrame([(d, i, s, 1) for d, own in series.items() for i, s in enumerate(own)], "div string, position long, hits long, total long")
    for side in ("left", "right"):
        got = {r.div: (r.edge, r.hits, r.total) for r in coverage.change_points(frame, side).collect()}
        assert got == {d: brute_change(own, side == "right") for d, own in series.items()}


def test_pairs_on_both_strands(spark):
    schema = "read int, chrom string, strand string, pos long, qpos long"
    five = spark.createDataFrame([(1, "c", "+", 100, 0), (1, "c", "-", 100, 0), (2, "c", "+", None, 0)], schema)
    three = spark.createDataFrame([(1, "c", "+", 150, 30), (1, "c", "-", 60, 30), (1, "c", "+", 90, 30), (1, "c", "+", 301, 30), (1, "d", "+", 150, 30)], schema)
    assert rows(regions.pair_matches(five, three, 200), "strand", "pos3", "span") == [("+", 150, 50), ("-", 60, 40)]
    sites = spark.createDataFrame([("c", "-", 50), ("c", "-", 20)], "chrom string, strand string, pos long")
    assert rows(regions.pair_splice_sites(sites, sites, 40), "donor", "acceptor", "length") == [(50, 20, 30)]


def test_filters_without_figures(spark):
    frame = spark.createDataFrame([(1, None, 0.9), (2, 0.9, None), (3, 0.9, 0.9)], "id int, coverage double, identity double")
    assert rows(regions.passing(frame, 0.5, 0.5), "id") == [(3,)]
    found = spark.createDataFrame([(1, 9, 100), (2, 50, 100), (2, 12, 100), (2, 13, 100)], "read int, n_covered int, length int")
    assert rows(regions.well_covered(found), "read", "n_covered") == [(2, 13), (2, 50)]


def test_trimming_and_back_translation(spark):
    frame = spark.createDataFrame([("NNACGTnn",), ("NNNN",), ("",), ("ACGT",)], "seq string")
    assert rows(frame.select(regions.trim_bounds(F.col("seq")).alias("x")).select("x.*"), "trim_start", "trim_end") == [(0, 0), (0, 4), (2, 6), (4, 4)]
    got = spark.createDataFrame([("MLS*w?",)], "p string").select(sq.back_translate(F.col("p")).alias("s")).first().s
    assert got == "ATGYTNWSNTRRTGGNNN"


def test_kmers_of_long_sequences_take_linear_time(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PART", 100)
    text = "ACGTNACGGT" * 200
    frame = spark.createDataFrame([(1, text), (2, None), (3, "ACG"), (4, "acgtacgtacgt")], "id int, seq string")
    got = rows(kmers.kmer_positions(frame, 4, 3).withColumn("text", sq.kmer_text(F.col("kmer"), 4)), "id", "pos", "text")
    assert got == sorted([(1, i, text[i : i + 4]) for i in range(0, len(text) - 3, 3) if "N" not in text[i : i + 4]], key=repr)
    monkeypatch.undo()
    took = []
    for n in (100_000, 1_600_000):
        start = time.time()
        assert kmers.rolling_codes("ACGTTGCA" * (n // 8), 15)[1].all()
        took.append(time.time() - start)
    assert took[1] < 100 * max(took[0], 0.01)
