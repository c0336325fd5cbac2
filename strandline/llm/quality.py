"""Quality rules: a table of thresholds compiled into one projection over a text's own counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

#: White space between words, as a class of Java and RE2 patterns and as characters.
SPACE_CLASS, SPACES = r"[\x20\x09-\x0D]", " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STOP_WORDS = """a an and are as at be but by for from had has have he in is it not of on or she that the they this to was were
which with you aber als auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist mit nicht
sich sie sind so um und von werden wie zu au aux avec ce ces dans de du elle en est et il la le les leur mais ne nous
ont ou où par pas pour que qui sa ses son sont sur un une vous al como con del el ella entre era esta este fue ha las lo
los más muy no o para pero por se sin sobre su sus también una y ya""".split()

#: (rule, measure, least, most): a text passes where the measure lies within; null leaves that end open.
RULES = (
    ("length", "n_words", 10, None),
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("shouting", "exclamation_ratio", None, 0.3),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_words", "repeat_word_ratio", None, 0.2),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
)

#: One stop word is given to every text, so that the ratio means nothing for the shortest ones.
_MEASURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "exclamation_ratio": "n_exclamations / greatest(n_words, 1)",
    "stop_word_ratio": "(n_stop_words + 1) / greatest(n_words, 1)",
    "repeat_word_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}


def split_words(text: Column) -> Column:
    """Words between runs of white space, in order; none for an empty text."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE_CLASS}+"))


def _count_of(chars: str) -> str:
    return f"cast(length(text) - length(translate(text, '{chars}', '')) as bigint)"


def counts(docs: DataFrame) -> DataFrame:
    """The documents' (doc_id, text) with a text's own counts as further columns.

    n_repeat_words counts the words under 5-word windows that occur again in the text. A window is known by the 64-bit hash
    of its words in order. Only texts in which two hashes agree are sorted, so the work is n log n of a text at most;
    all of it happens within the row.
    """
    w = WINDOW
    rows = docs.withColumn("words", split_words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    grams = f"CASE WHEN size(words) < {w} THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, size(words) - {w - 1}), i -> xxhash64(slice(words, i, {w}))) END"
    rows = rows.withColumn("grams", F.expr(grams))
    # (hash, place) in order, for the texts with a hash that comes twice
    rows = rows.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(grams)) = size(grams) THEN NULL ELSE sort_array(transform(grams, (h, i) -> struct(h, i))) END"))
    places = "transform(filter(sequence(0, size(sorted) - 1), j -> get(sorted, j).h <=> get(sorted, j - 1).h OR get(sorted, j).h <=> get(sorted, j + 1).h), j -> get(sorted, j).i)"
    rows = rows.withColumn("places", F.expr(f"CASE WHEN sorted IS NULL THEN NULL ELSE sort_array({places}) END"))
    covered = f"aggregate(zip_with(places, slice(places, 2, greatest(size(places), 1)), (a, b) -> least({w}, coalesce(b - a, {w}))), 0L, (s, x) -> s + x)"
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.expr(_count_of(SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN places IS NULL THEN 0L ELSE {covered} END").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr(_count_of("!")).alias("n_exclamations"),
        F.expr(f"cast(size(filter(words, x -> lower(x) IN ({stop}))) as bigint)").alias("n_stop_words"),
    )


def verdict(rules=RULES, measures=None) -> Column:
    """The table of rules as one expression over counts(): true where every rule passes."""
    measures, parts = measures or _MEASURES, []
    for _, measure, least, most in rules:
        value = f"({measures.get(measure, measure)})"
        parts += [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
    return F.expr(" AND ".join(parts) or "true")


def assess(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: its counts, base_failed (under 10 words, or over a fifth of them in repeated windows) and kept.

    Null texts count as empty and fail for their length. Every row is judged by itself: repeated rows give repeated
    results, other columns are left behind, and there is no shuffle. kept is false where base_failed, else the verdict of rules.
    """
    rows = counts(texts(docs)).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RE_SPACE = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)
_PASS = " AND ".join(
    f"({_MEASURES.get(m, m)}) {sign} {bound}" for _, m, least, most in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None
)
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{_RE_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
g AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s WHERE len(words) >= {WINDOW})
),
twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
repeats AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS BIGINT) AS n_repeat_words FROM twice GROUP BY r),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclamations,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM s LEFT JOIN repeats USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_PASS} AS kept
FROM c
"""
