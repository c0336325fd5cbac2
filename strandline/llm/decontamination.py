"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, rows_with_keys, table, texts
from .licenses import words_of

#: Words of a shingle, and the share of an item's distinct shingles that a document must hold.
WIDTH, CONTAINMENT = 5, 0.8
#: Rows up to which a side is broadcast; beyond that both sides are shuffled by the join key.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def index_items(benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, item, width, n_item, need, size_class, h, shingle, in_sketch): a row per item and distinct shingle.

    item numbers the distinct texts of an item_id by their hash. Items of fewer words than width are one shingle of their own width; items
    without words are left out. need is the number of shingles that a document must hold; size_class is the power of two
    below it. A document that holds need of n shingles misses n - need at most, so it holds one at least of the
    n - need + 1 with the least hashes: this bottom-k MinHash sketch finds every such document.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("item_id", F.xxhash64("text").alias("item"), words_of(F.col("text")).alias("w")).distinct().where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(width))).withColumn("shingles", F.expr("array_distinct(transform(sequence(1, size(w) - width + 1), i -> array_join(slice(w, i, width), ' ')))"))
    rows = rows.withColumn("n_item", F.size("shingles")).withColumn("need", F.ceil(F.col("n_item") * F.lit(containment) - F.lit(1e-9)).cast("int"))
    rows = rows.withColumn("hashed", F.expr("sort_array(transform(shingles, s -> struct(xxhash64(s) AS h, s AS shingle)))"))
    placed = rows.select("item_id", "item", "width", "n_item", "need", F.floor(F.log2(F.greatest("need", F.lit(1)))).cast("int").alias("size_class"), F.posexplode("hashed").alias("at", "x"))
    return placed.select("item_id", "item", "width", "n_item", "need", "size_class", "x.h", "x.shingle", (F.col("at") <= F.col("n_item") - F.col("need")).alias("in_sketch"))


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def _shingles(width: int, of: str) -> Column:
    """An array over the shingles of the words w, in order; null for texts of fewer words."""
    return F.expr(f"CASE WHEN size(w) >= {width} THEN transform(sequence(1, size(w) - {width - 1}), i -> {of.format(f'slice(w, i, {width})')}) END")


def _candidates(docs: DataFrame, sketches: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash) of the documents that have a shingle of a sketch, and shingles enough for that item.

    A document's size class is the power of two below its number of shingles: it meets the classes of items it can hold.
    """
    w = docs.select(*_row_key(), words_of(F.col("text")).alias("w"))
    w = w.select("doc_id", "text_hash", _shingles(width, "xxhash64(array_join({}, ' '))").alias("hs"))
    # outer and coalesce: else filters on the arrays are inferred and pushed down to where each lambda step would split the text again
    klass = F.coalesce(F.floor(F.log2(F.greatest(F.size("hs"), F.lit(1)))).cast("int"), F.lit(0)).alias("doc_class")
    w = w.select("doc_id", "text_hash", "hs", klass)
    grams = w.select("doc_id", "text_hash", "doc_class", F.explode_outer("hs").alias("g"))
    return grams.join(sketches, (F.col("g") == F.col("h")) & (F.col("size_class") <= F.col("doc_class"))).select("doc_id", "text_hash").distinct()


def _shared(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, item_id, item, n_item, n_shared) where a document holds what an item needs: its shingles as text, each once."""
    w = docs.select(*_row_key(), words_of(F.col("text")).alias("w"))
    grams = w.select("doc_id", "text_hash", F.explode_outer(F.array_distinct(_shingles(width, "array_join({}, ' ')"))).alias("g"))
    met = grams.join(items, F.col("g") == F.col("shingle"))
    return met.groupBy("doc_id", "text_hash", "item_id", "item", "n_item", "need").agg(F.count_distinct("g").alias("n_shared")).where("n_shared >= need").drop("need")


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared, containment): items of which a document holds that share of distinct shingles.

    Words are lower-case runs of letters and digits, so case and punctuation do not matter. The sketches of the items find candidate documents
    in one scan without a shuffle of texts; only those are read again and compared with all shingles of the items. The result is that of
    comparing every document with every item. Null texts have no words, on either side. Repeated documents give the same
    rows once; two texts under one doc_id are judged apart (text_hash tells them); of two texts under one item_id the better one counts.
    The index is broadcast while it is small, else joined by shuffling hashes: a shingle that very many documents share
    is then one hot key among the documents, which adaptive execution splits.
    """
    spark, docs = docs.sparkSession, texts(docs)
    items = materialise(index_items(benchmark, width, containment), "items")
    sizes = {r.width: (r.n, r.sketch) for r in items.groupBy("width").agg(F.count("*").alias("n"), F.count_if("in_sketch").alias("sketch")).collect()}
    found = None
    for w, (n, sketch) in sorted(sizes.items()):  # one width, unless items are shorter than a shingle
        of_width = items.where(F.col("width") == w)
        hits = materialise(_candidates(docs, _small(of_width.where("in_sketch").select("h", "size_class").distinct(), sketch), w), "candidates")
        keys = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
        rows = docs.join(_small(keys, keys.count()), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")), "left_semi")
        part = _shared(rows, _small(of_width.select("item_id", "item", "n_item", "need", "shingle"), n), w)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, n_item int, n_shared long, containment double")
    share = (F.col("n_shared") / F.col("n_item")).alias("containment")
    best = found.select("doc_id", "text_hash", "item_id", F.struct(share, "n_item", "n_shared").alias("x")).groupBy("doc_id", "text_hash", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "text_hash", "item_id", "x.n_item", "x.n_shared", "x.containment")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, columns and all."""
    found = materialise(contained_items(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "contaminated")
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_hash"))
    return rows_with_keys(docs).join(_small(found, found.count()), same, "left_anti").select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", "containment").distinct()


OP5_SQL = rf"""
WITH words AS (
  SELECT doc_id, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w,
    hash(text) AS t
  FROM (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark)
),
items AS (
  SELECT DISTINCT item_id, t, least(len(w), {WIDTH}) AS width, unnest(list_transform(range(1, len(w) - least(len(w), {WIDTH}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' '))) AS shingle
  FROM words WHERE item_id IS NOT NULL AND len(w) > 0
),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id, t) AS n_item FROM items),
docs AS (
  SELECT DISTINCT doc_id, t, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS shingle
  FROM words, (SELECT DISTINCT width FROM items) WHERE doc_id IS NOT NULL AND len(w) >= width
),
shared AS (
  SELECT doc_id, d.t, item_id, s.t AS it, n_item, count(*) AS n_shared FROM docs d JOIN sized s USING (width, shingle)
  GROUP BY doc_id, d.t, item_id, s.t, n_item HAVING count(*) >= {CONTAINMENT} * n_item
)
SELECT DISTINCT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, n_shared, n_shared / n_item AS containment
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t, item_id ORDER BY n_shared / n_item DESC, n_item DESC, n_shared DESC) AS r FROM shared) WHERE r = 1
"""
