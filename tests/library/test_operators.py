"""Interval, coverage, k-mer and alignment operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from strandline.operators import alignments, coverage, dynamic, genome, intervals, kmers, mapping

INTERVALS = "id long, div string, low long, high long"


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(2)
    rows = []
    for i in range(250):
        low = rng.randrange(0, 900)
        rows.append((i, rng.choice("ab"), low, low + rng.choice([0, 3, 50, 400])))
    return rows, spark.createDataFrame([*rows, (900, None, 1, 5), (901, "a", None, 5), (902, "a", 9, 5)], INTERVALS)


def test_overlap(store):
    rows, frame = store
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    for size in (1, 7, 64, 5000):
        got = [(r.id, r.r_id) for r in intervals.overlap_join(frame, frame, size=size).collect()]
        assert len(got) == len(want) and set(got) == want
    some = {r.id for r in intervals.overlap_join(frame, frame, how="left_semi", condition=F.col("id") != F.col("r_id")).collect()}
    assert some == {a for a, b in want if a != b}
    first = {r.id: r.r_id for r in intervals.first_overlap(frame, frame).collect()}
    at = {r[0]: r for r in rows}
    assert first == {a: min((b for x, b in want if x == a), key=lambda b: (at[b][2], at[b][3], b)) for a in at}
    assert intervals.bin_width(frame) >= 50


@pytest.mark.parametrize("ring", [3, 100, 10_000])
def test_neighbours(store, ring):
    rows, frame = store
    for side in ("right", "left"):
        got = {(r.id, r["rank"]): r.r_id for r in intervals.neighbours(frame.where("low <= high"), frame.where("low <= high"), 3, side, ring=ring).collect()}
        want = {}
        for a in rows:
            beyond = [(b[2] - a[3], b[0]) for b in rows if b[1] == a[1] and b[2] > a[3]] if side == "right" else [(a[2] - b[3], b[0]) for b in rows if b[1] == a[1] and b[3] < a[2]]
            want |= {(a[0], i): b for i, (_, b) in enumerate(sorted(beyond)[:3], 1)}
        assert got == want


def test_depth(store):
    rows, frame = store
    runs = coverage.depth_runs(frame.where("low >= 1 AND low <= high"), closed=True).collect()
    for div in "ab":
        depth = {}
        for _, d, low, high in rows:
            if d == div and low >= 1:
                for p in range(low, high + 1):
                    depth[p] = depth.get(p, 0) + 1
        own = [r for r in runs if r.div == div]
        assert {p: r.depth for r in own for p in range(r.start, r.end + 1) if r.depth} == depth
        assert min(r.start for r in own) == 1 and sum(r.end - r.start + 1 for r in own) == max(r.end for r in own)


def test_locate(spark, monkeypatch):
    table = genome.chromosome_table(spark.createDataFrame([(1, "chr2", 50), (0, "chr10", 30), (2, "X", 20)], "ord int, chrom string, length long"), "chrom")
    assert [(r.chrom, r.offset) for r in table.orderBy("chrnum").collect()] == [("chr2", 0), ("chr10", 50), ("X", 80)]
    points = spark.createDataFrame([(p,) for p in (1, 50, 51, 80, 81, 100, 500, 0)], "pos long")
    want = {(1, "chr2", 1), (50, "chr2", 50), (51, "chr10", 1), (80, "chr10", 30), (81, "X", 1), (100, "X", 20), (500, "X", 420), (0, "chr2", 0)}
    for width in (1 << 20, 7, 1):
        monkeypatch.setattr(intervals, "PLACE_BIN", width)
        assert {(r.pos, r.chrom, r.chrpos) for r in intervals.locate(points, table).collect()} == want


def test_collapsed_diagonals(spark):
    rows = [(1, 2, d) for d in (0, 5, 12, 13, 24, 26, 100)]
    got = {r.diagonal: r.base for r in kmers.collapse_diagonals(spark.createDataFrame(rows, "query long, target long, diagonal long")).collect()}
    assert got == {0: 0, 5: 0, 12: 0, 13: 13, 24: 13, 26: 26, 100: 100}


def test_alleles(spark):
    windows = spark.createDataFrame([(1, 10, "ACGT"), (1, 20, "AAAA")], "id long, pos long, kmer string")
    snps = spark.createDataFrame([(1, 11, ["T"]), (1, 13, ["A", "G"])], "id long, pos long, alternates array<string>")
    made = kmers.expand_alleles(windows, snps).select(F.col("pos"), "kmer").collect()
    from itertools import product

    want = {"".join(x) for x in product("A", "CT", "G", "TAG")} - {"ACGT"}
    code = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
    assert {(r.pos, r.kmer) for r in made} == {(10, code(w)) for w in want}


def test_duplicates(spark):
    chroms = spark.createDataFrame([("c1", 0), ("c2", 1000)], "chrom string, offset long")
    rows = [
        (0, "a", 0, "c1", 105, "5S20M", "=", 0, "ACGT"), (1, "b", 0, "c1", 100, "20M", "=", 0, "ACGT"), (2, "c", 0, "c1", 100, "20M", "=", 0, "TTTT"),
        (3, "d", 16, "c1", 100, "20M", "=", 0, "ACGT"), (4, "e", 4, "*", 0, "*", "*", 0, "ACGT"), (5, "f", 4, "*", 0, "*", "*", 0, "ACGT"), (6, "b", 256, "c2", 5, "20M", "=", 0, "ACGT"),
    ]
    sam = spark.createDataFrame(rows, "ord long, qname string, flag int, rname string, pos long, cigar string, rnext string, pnext long, seq string")
    got = {r.ord: (r.duplicate, r.flag) for r in alignments.mark_duplicates(sam, chroms).collect()}
    assert {o for o, (d, _) in got.items() if d} == {1, 5, 6} and got[1][1] == 1024 and got[6][1] == 1280
    assert {r.ord for r in alignments.mark_duplicates(sam, chroms, mark_first=True).where("duplicate").collect()} == {0, 1, 4, 5, 6}
    assert [r.ord for r in alignments.sort_sam(sam, chroms).collect()][-2:] == [4, 5]
    again = alignments.mark_duplicates(sam.where("qname NOT IN ('b', 'f')"), chroms)
    assert again.where("duplicate").count() == 0


def slow_align(q, g, match=1, mismatch=-3, open_=-8, extend=-3):
    n, m, low = len(q), len(g), -(10**6)
    h, d, r = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                d[i][j] = max(h[i - 1][j] + open_ + extend, d[i - 1][j] + extend)
            if j:
                r[i][j] = max(h[i][j - 1] + open_ + extend, r[i][j - 1] + extend)
            if i or j:
                h[i][j] = max(d[i][j], r[i][j], h[i - 1][j - 1] + (match if q[i - 1] == g[j - 1] else mismatch) if i and j else low)
    return h[n][m]


def cigar_score(q, g, cigar, match=1, mismatch=-3, open_=-8, extend=-3):
    import re

    i = j = total = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            total += sum(match if a == b else mismatch for a, b in zip(q[i : i + n], g[j : j + n], strict=True))
            i, j = i + n, j + n
        else:
            total, i, j = total + open_ + n * extend, i + n * (op == "I"), j + n * (op == "D")
    assert (i, j) == (len(q), len(g))
    return total


def test_banded_alignment():
    rng = random.Random(4)
    for _ in range(60):
        g = "".join(rng.choices("ACGT", k=rng.randrange(1, 30)))
        q = list(g)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(q) + 1)
            q[at : at + rng.randrange(0, 2)] = rng.choice(["", "A", "CG"])
        q = "".join(q)
        score, cigar = dynamic.banded(q, g, band=40)
        assert score == slow_align(q, g) == cigar_score(q, g, cigar), (q, g, cigar)


def test_chains():
    import itertools

    import numpy as np

    rng = random.Random(6)
    for _ in range(40):
        seg = [(f := rng.randrange(0, 200), f + rng.randrange(10, 50), rng.randrange(0, 60_000), rng.randrange(5, 40)) for _ in range(6)]
        found, path = dynamic.chain(*(np.array(x) for x in zip(*seg, strict=True)))
        best = max(s[3] for s in seg)
        for k in (2, 3):
            for p in itertools.permutations(seg, k):
                steps = list(zip(p, p[1:], strict=False))
                if all(a[2] <= b[2] and b[2] - a[2] < 100_000 and a[1] < b[1] and (a[0], a[1], a[2]) <= (b[0], b[1], b[2]) for a, b in steps):
                    best = max(best, sum(s[3] for s in p) - sum((b[2] - a[2]) / 10_000 + max(0, a[1] - b[0] + 1) for a, b in steps))
        assert found == pytest.approx(best) and len(path) <= 3


def test_breaks_adapters_and_trims():
    assert dynamic.best_break("AAAACCCC", "AAAATTTT", "GGGGCCCC") == (4, 0) and dynamic.best_break("AAA", "AAA", "AAA") == (-1, -1)
    assert dynamic.splice_break("AAAACCCC", "AAAAGTTTTT", "GGAGCCCC")[::2] == (4, "GT-AG")
    read = "ACGTTGCAACGGTTACCATGCGATTACGAT"
    assert dynamic.adapter_offset("GG" + read, read + "TT") in (0, 2) and dynamic.pair_overlap("TTTT" + read[:15], read[:15] + "GGGG") == 15 and dynamic.pair_overlap("A" * 12, "C" * 12) == 0
    assert dynamic.trim_end([True] * 10 + [False, True, False]) == 10 and dynamic.trim_end([True, False], 0) == 2
    state = dynamic.good_stretch([True] * 30 + [False, True] * 10 + [True] * 30)
    assert state[:25].all() and not state[32:48].any() and state[-20:].all()


def test_reads_are_placed_like_brute_force(spark):
    rng = random.Random(7)
    chroms = [("c1", "".join(rng.choices("ACGT", k=700))), ("c2", "".join(rng.choices("ACGT", k=500)))]
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = []
    for i in range(25):
        name, seq = rng.choice(chroms)
        at = rng.randrange(len(seq) - 60)
        read = list(seq[at : at + 60])
        for _ in range(rng.randrange(0, 4)):
            read[rng.randrange(60)] = rng.choice("ACGT")
        reads.append((i, turn("".join(read)) if rng.random() < 0.5 else "".join(read)))
    want = set()
    for i, read in reads:
        for strand, q in (("+", read), ("-", turn(read))):
            for name, seq in chroms:
                for p in range(len(seq) - 59):
                    mism = sum(a != b for a, b in zip(q, seq[p : p + 60], strict=True))
                    if mism <= 3:
                        want.add((i, name, p + 1, strand, mism))
    got = mapping.place_reads(spark.createDataFrame(reads, "read long, seq string"), spark.createDataFrame(chroms, "chrom string, seq string"), k=10, most=3)
    assert {(r.read, r.chrom, r.pos, r.strand, r.mism) for r in got.collect()} == want and len(want) >= 25


def test_a_long_query_is_spliced(spark):
    rng = random.Random(8)
    bases = lambda n: "".join(rng.choices("ACGT", k=n))
    e1, e2, e3 = bases(80), bases(70), bases(90)
    seq = bases(200) + e1 + "GT" + bases(300) + "AG" + e2 + "GT" + bases(150) + "AG" + e3 + bases(100)
    turned = (e1 + e2 + e3)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    queries = spark.createDataFrame([(1, e1 + e2 + e3), (2, turned)], "query long, seq string")
    rows = mapping.place_long(queries, spark.createDataFrame([("c", seq)], "chrom string, seq string")).orderBy(F.desc("score")).collect()
    best = {r.query: r for r in reversed(rows)}
    for q, strand in ((1, "+"), (2, "-")):
        r = best[q]
        assert r.strand == strand and r.matches == 240
        assert [(x.qstart, x.qend, x.gstart, x.gend) for x in r.exons] == [(1, 80, 201, 280), (81, 150, 585, 654), (151, 240, 809, 898)]
        assert [x.intron for x in r.exons] == ["GT-AG", "GT-AG", ""]


def test_fetch_and_contigs(spark):
    seq = "".join(random.Random(9).choices("ACGT", k=300))
    pieces = genome.chunks(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 64)
    ranges = spark.createDataFrame([(1, "c", 60, 200, 1), (2, "c", 1, 64, -1), (3, "c", 290, 310, 1), (4, "d", 1, 2, 1)], "id long, chrom string, low long, high long, sign int")
    got = {r.id: r.seq for r in genome.fetch(ranges, pieces, 64).collect()}
    assert got == {1: seq[59:200], 2: seq[:64][::-1].translate(str.maketrans("ACGT", "TGCA")), 3: None, 4: None}
    contigs = spark.createDataFrame([(0, "k1", "chr1:101..150", 50), (1, "k2", "Homo chromosome 3, part", 10), (2, "k3", "chromosome 3", 5), (3, "k4", None, 7), (4, "k1", "twice", 9)], "ord int, acc string, rest string, length long")
    assert {tuple(r) for r in genome.assign_contigs(contigs).collect()} == {("k1", "chr1", 101, 150), ("k2", "3", 1, 10), ("k3", "3", 11, 15), ("k4", "k4", 1, 7)}


def test_running_totals_with_ties_in_position(spark):
    rows = spark.createDataFrame([(1, 2, "b", 5), (1, 2, "a", 7), (1, 1, "c", 3), (1, 2, "a", 4)], "id long, position long, div string, count long")
    got = coverage.running_before(rows, ("position", "div", "count"), by=("id",)).orderBy("running_before").collect()
    assert [(r.div, r["count"], r.running_before) for r in got] == [("c", 3, 0), ("a", 4, 3), ("a", 7, 7), ("b", 5, 14)]
