"""Chat formatting: conversations as token ids with reserved turn marks, a loss mask and reversible escapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tune

#: Marks and their ids, which lie beyond the tokenizer's own vocabulary (50,257 ids).
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
RESERVED = {TURN: 50_257, BODY: 50_258, END: 50_259}
#: Strings that some template gives a meaning; none is left as it is inside a text.
CONTROL = (TURN, BODY, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL)
_ESCAPE, _UNESCAPE = re.compile(rf"(?:{_ANY})"), re.compile(rf"({_ANY})\\")
TRAINED_ROLE = "assistant"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())), ("formatted", pa.string())])
_DDL = "conv_id long, seq long, start long, ids array<int>, loss_mask array<tinyint>, formatted string"


def escape(text: str) -> str:
    r"""Put one backslash more behind the first character of every control string: <s> becomes <\s>, <\s> becomes <\\s>."""
    return _ESCAPE.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    """Undo escape()."""
    return _UNESCAPE.sub(r"\1", text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def assemble(turns: list[tuple[str, str]], path: str) -> list[tuple[list[int], list[int], str]]:
    """(ids, loss mask, formatted text) of each (role, text): segments are encoded apart and joined by reserved ids."""
    parts = [s for role, text in turns for s in (escape(role), escape(text))]
    encoded = [e.ids for e in _tokenizer(path).encode_batch(parts, add_special_tokens=False)]
    out = []
    for (role, _), head, body, a, b in zip(turns, encoded[::2], encoded[1::2], parts[::2], parts[1::2], strict=True):
        segments = [[RESERVED[TURN]], head, [RESERVED[BODY]], body, [RESERVED[END]]]
        ends = list(accumulate(map(len, segments)))  # the body stands from the third end to the fourth
        mask = [0] * ends[2] + [int(role == TRAINED_ROLE)] * len(body) + [0]
        out.append(([i for s in segments for i in s], mask, f"{TURN}{a}{BODY}{b}{END}"))
    return out


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, start, first = None, 0, 0, True
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            rows = []
            for c, (ids, mask, text) in zip(columns[0], assemble(list(zip(columns[1], columns[2], strict=True)), path), strict=True):
                if first or c != conv:
                    conv, seq, start, first = c, 0, 0, False
                rows.append((c, seq, start, ids, mask, text))
                seq, start = seq + 1, start + len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Conversations whole in a partition, rows in order: they stream by one batch at a time, however long they are."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *keys)


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per turn: conv_id, seq (from 0), start (ids of the conversation before), ids, loss_mask, formatted.

    A conversation is the concatenation of its rows by seq; under the mask stand exactly the assistant's texts. Null texts
    and roles count as empty; rows without conv_id form one conversation; equal turns are ordered by role and text, and
    repeated rows are all kept. A conversation's rows stream through one task, since each start needs those before; that
    task holds a batch at a time.
    """
    tune(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    return _in_order(rows, "turn", "role", "text").mapInArrow(_format(tokenizer or default_tokenizer()), _DDL)


def _digest(path: str):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        conv, state, done = None, None, []

        def close() -> tuple:
            turns, loss, n, chars, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            for c, ids, mask, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "ids", "loss_mask", "formatted")), strict=True):
                if state is None or c != conv:
                    if state:
                        done.append(close())
                    conv, state = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                body = ids.index(RESERVED[BODY])
                role = unescape(tokenizer.decode(ids[1:body], skip_special_tokens=False))
                said = unescape(tokenizer.decode(ids[body + 1 : -1], skip_special_tokens=False))
                state[0].update(f"{role}\n{said}\n".encode())
                under = unescape(tokenizer.decode([i for i, m in zip(ids, mask, strict=True) if m], skip_special_tokens=False))
                state[1].update(under.encode())
                state[2:] = state[2] + 1, state[3] + len(under), state[4] + len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(close(), schema, strict=True)], schema=schema)

    return run


def digests(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What can be read back from format_conversations()' rows, by conversation."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _in_order(formatted, "seq").mapInArrow(_digest(tokenizer or default_tokenizer()), ddl)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, TRAINED_ROLE, said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in more.schema))
    return digests(materialise(format_conversations(rows.union(more)), "chat"))


_SQL_CONTROL = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL)
OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(BODY) + len(END)} + length(role) + length(text)
    + len(regexp_extract_all(role, '{_SQL_CONTROL}')) + len(regexp_extract_all(text, '{_SQL_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
