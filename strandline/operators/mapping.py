"""Placing short reads and long queries on a reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from . import dynamic, genome, kmers


def place_reads(reads: DataFrame, sequences: DataFrame, k: int = 12, interval: int = 1, most: int | None = None, frequent: int = 1000, mode: str = "standard") -> DataFrame:
    """(read, chrom, pos, strand, mism, matches): all places of reads (read, seq) on sequences (chrom, seq) that a k-mer finds, with at most `most` mismatches.

    Both strands are searched; pos counts from 1. Without most, the limit is (length + interval - 1) / k - 2, at least 0. A read of length n with m
    mismatches keeps an exact k-mer of the index wherever n >= (m + 1) (k + interval - 1), so there nothing is missed. k-mers with more than
    frequent places are cut before the join. In a mode (cmet, atoi, ttoc) bases are compared and indexed after its change.
    """
    turned = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("q")), F.struct(F.lit("-").alias("strand"), sq.reverse_complement(F.col("seq")).alias("q")))).alias("x")
    both = reads.select("read", turned).select("read", "x.strand", "x.q")

    def reduced(rows: DataFrame, text: str, plus: bool) -> DataFrame:
        return rows.withColumn("_s", sq.reduce_bases(F.col(text), mode, plus))

    hits = None
    for plus in (True, False) if mode != "standard" else (True,):
        side = both if mode == "standard" else both.where(F.col("strand") == ("+" if plus else "-"))
        index = kmers.without_frequent(kmers.kmer_positions(reduced(sequences, "seq", plus), k, interval, "chrom", "_s"), frequent)
        keyed = reduced(side, "q", plus).withColumn("_key", F.struct("read", "strand"))
        found = kmers.seeds(kmers.kmer_positions(keyed, k, 1, "_key", "_s"), index, "_key", "chrom").select("query.read", "query.strand", F.col("target").alias("chrom"), (F.col("diagonal") + 1).cast("long").alias("pos")).distinct()
        places = found.where("pos >= 1").join(side, ["read", "strand"]).withColumn("id", F.struct("read", "strand", "chrom", "pos"))
        ranges = places.select("id", "chrom", F.col("pos").alias("low"), (F.col("pos") + F.length("q") - 1).alias("high"), F.lit(1).alias("sign"), "q")
        got = genome.fetch(ranges, genome.chunks(sequences)).where(F.col("seq").isNotNull())
        limit = F.lit(most) if most is not None else F.greatest(F.floor((F.length("q") + interval - 1) / k) - 2, F.lit(0))
        mism = sq.mismatches(F.col("q"), F.col("seq"), mode, plus)
        part = got.select("id.*", mism.alias("mism"), F.length("q").alias("n"), limit.alias("_limit")).where(F.col("mism") <= F.col("_limit"))
        part = part.select("read", "chrom", "pos", "strand", "mism", (F.col("n") - F.col("mism")).alias("matches"))
        hits = part if hits is None else hits.union(part)
    return hits


def place_long(queries: DataFrame, sequences: DataFrame, k: int = 12, frequent: int = 1000, gap: int = 12) -> DataFrame:
    """(query, chrom, strand, score, exons, matches): long queries (query, seq) as chains of exons on sequences (chrom, seq).

    Seeds are gathered on diagonals; seeds on one diagonal make a segment; the best chain of up to three segments is refined at its
    borders, where the place of the intron is moved to the fewest mismatches and a canonical intron. exons: structs qstart,
    qend, gstart, gend (closed, from 1; on the minus strand of the reversed query) and the two bases at either end of the next intron.
    """
    turned = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("q")), F.struct(F.lit("-").alias("strand"), sq.reverse_complement(F.col("seq")).alias("q")))).alias("x")
    both = queries.select("query", turned).select("query", "x.strand", "x.q")
    index = kmers.without_frequent(kmers.kmer_positions(sequences, k, 1, "chrom"), frequent)
    found = kmers.seeds(kmers.kmer_positions(both.withColumn("_key", F.struct("query", "strand")), k, 1, "_key", "q"), index, "_key", "chrom")
    segments = found.groupBy("query", "target", "diagonal").agg(F.count("*").alias("n"), F.min("qpos").alias("first"), (F.max("qpos") + k - 1).alias("last"))
    grouped = segments.groupBy("query", "target").agg(F.collect_list(F.struct("diagonal", "first", "last", "n")).alias("segments"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    rows = grouped.select("query.*", F.col("target").alias("chrom"), "segments", "low", "high").join(both, ["query", "strand"])
    # the stretch of the reference that the chain can reach
    ranges = rows.withColumn("id", F.struct("query", "strand", "chrom")).withColumn("from", F.greatest(F.col("low") + 1, F.lit(1))).withColumn("to", F.col("high") + F.length("q"))
    sizes = sequences.select("chrom", F.length("seq").alias("size"))
    ranges = ranges.join(sizes, "chrom").select("id", "chrom", F.col("from").alias("low"), F.least("to", F.col("size")).alias("high"), F.lit(1).alias("sign"), "q", "segments")
    got = genome.fetch(ranges, genome.chunks(sequences)).select("id.*", "q", "segments", F.col("low").alias("start"), F.col("seq").alias("region"))
    kind = "query long, chrom string, strand string, score double, matches long, exons array<struct<qstart:bigint,qend:bigint,gstart:bigint,gend:bigint,intron:string>>"
    return got.mapInPandas(_refine, kind)


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples():
            table = pd.DataFrame(list(map(lambda s: s if isinstance(s, dict) else s.asDict(), r.segments)))
            score, path = dynamic.chain(*(table[c].to_numpy() for c in ("first", "last", "diagonal", "n")))
            parts = [table.iloc[p] for p in path]
            at, exons, matches = int(parts[0]["first"]), [], 0
            genome_at = lambda d, i: int(d) + i - (r.start - 1)  # noqa: E731  of query offset i on diagonal d, in the region
            for a, b in zip(parts, [*parts[1:], None], strict=True):
                if b is None:
                    end, intron = int(a["last"]) + 1, ""
                else:
                    low, high = max(at, min(int(a["last"]) - 12, int(b["first"]) - 12)), min(int(b["last"]) + 1, max(int(a["last"]), int(b["first"])) + 12)
                    q = r.q[low:high]
                    left = r.region[genome_at(a["diagonal"], low) :][: len(q) + 2]
                    start = genome_at(b["diagonal"], low)
                    right = r.region[max(0, start) :][: len(q)]
                    place, _, intron = dynamic.splice_break(q, left, right) if start >= 0 else (0, 0, "")
                    end = low + place
                g = r.region[genome_at(a["diagonal"], at) : genome_at(a["diagonal"], end)]
                matches += sum(x == y for x, y in zip(r.q[at:end], g, strict=False))
                exons.append({"qstart": at + 1, "qend": end, "gstart": int(a["diagonal"]) + at + 1, "gend": int(a["diagonal"]) + end, "intron": intron})
                at = end
            out.append({"query": r.query, "chrom": r.chrom, "strand": r.strand, "score": round(score, 6), "matches": matches, "exons": exons})
        yield pd.DataFrame(out, columns=["query", "chrom", "strand", "score", "matches", "exons"])


def dominated(regions: DataFrame, by: str = "query") -> DataFrame:
    """Regions (query, id, low, high, score) without those that overlap a better one of the same query (of equal scores the lesser id)."""
    other = regions.select(*(F.col(c).alias(f"o_{c}") for c in (by, "id", "low", "high", "score")))
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_id") < F.col("id")))
    return regions.join(other, (F.col(by) == F.col(f"o_{by}")) & (F.col("low") <= F.col("o_high")) & (F.col("o_low") <= F.col("high")) & better, "left_anti")


def covered_enough(regions: DataFrame, by: str = "query", length: str = "qlength", covered: str = "ncovered") -> DataFrame:
    """Regions that cover more than a quarter of what the best region of their query covers; none, where that is below a tenth of the query."""
    best = regions.groupBy(by).agg(F.max(covered).alias("_best"))
    return regions.join(best, by).where((F.col("_best") >= 0.1 * F.col(length)) & (F.col(covered) > 0.25 * F.col("_best"))).drop("_best")
