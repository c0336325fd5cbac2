"""Secret scans: base rules, and Markov models that tell random strings from ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter run holds no match
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Labelled samples: words that identifiers are made of, and the seed and number of samples for each label.
WORDS = """account action active address agent alias alpha amount answer append apply archive array asset async attach
audio author balance batch begin binary block bottom branch bridge buffer build bundle button cache call cancel canvas
case center channel chart check child class clean click client clock close cluster code collect color column command
common compare compile config connect content context control convert copy count create current cursor data date debug
default delete depth detail device dialog direct display document domain double download draft driver edit element email
empty enable encode engine entry error event example execute export extend factory failed feature fetch field file filter
final finish first flag float focus folder font format forward frame function gateway general global graph group handle
hash header height helper hidden history host image import index info inner input insert instance integer internal
invoice item join kernel keyboard label language last layer layout left length level library limit line link list load
local location lock logger login loop machine main manager map margin mask master match matrix maximum member memory menu
merge message method middle minimum mobile model module monitor month mouse move multi name native network node normal
notify number object offset online open option order origin output owner package page panel parent parse partial path
pattern pause payload pending person phone pixel plain player plugin point policy pool position prefix preview price
primary print private process product profile project property provider public queue quick random range reader ready
record reduce refresh region register release remote remove render repeat replace report request reset resolve resource
response result return review right role root router row rule sample save scale schema scope screen script scroll search
section select sender sequence server service session setting shadow shape share shell signal simple single size slice
snapshot socket sort source spec split stack stage start state static status step storage store stream string style
submit summary support switch symbol sync system table target task team template test text theme thread time title toggle
tool top total trace track transfer transform tree trigger type union unique unit update upload user utils valid value
vector version video view visible wait warning watch weight widget width window worker wrapper write year zone""".split()
SEED, SAMPLES = 20_151, 4_000
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def labelled_samples(seed: int = SEED, n: int = SAMPLES) -> list[tuple[str, int]]:
    """(string, 1 if random): keys as generators of several alphabets make them, and identifiers, paths and slugs."""
    rng, out = random.Random(seed), []
    kinds = ("0123456789abcdef", _ALPHABET[:62], _ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    for i in range(n):
        out.append(("".join(rng.choices(kinds[i % len(kinds)], k=rng.randrange(16, 65))), 1))
        words = rng.choices(WORDS, k=rng.randrange(2, 6))
        sep = rng.choice(("_", "-", "/", "", "camel"))
        text = words[0] + "".join(w.title() for w in words[1:]) if sep == "camel" else sep.join(words)
        text = text.upper() if rng.random() < 0.15 else text
        out.append((text + rng.choice(("", "", f"{rng.randrange(100)}", f"_{rng.randrange(1990, 2030)}", f"-v{rng.randrange(10)}")), 0))
    return out


class MarkovPair:
    """Two first-order character models; score() is their mean log-likelihood ratio, positive for random strings."""

    def __init__(self, samples: list[tuple[str, int]]) -> None:
        logs = []
        for label in (0, 1):
            pairs, heads = Counter(), Counter()
            for text, kind in samples:
                if kind == label:
                    for a, b in zip("^" + text, text, strict=False):
                        pairs[a, b] += 1
                        heads[a] += 1
            logs.append({(a, b): math.log((pairs[a, b] + 0.5) / (heads[a] + 0.5 * len(_ALPHABET))) for a in "^" + _ALPHABET for b in _ALPHABET})
        self.ratio = {k: logs[1][k] - logs[0][k] for k in logs[0]}
        # between the classes: the least mean ratio that no ordinary sample reaches, with room to spare
        self.threshold = max(0.25, max((self.score(t) for t, kind in samples if not kind and len(t) >= 16), default=0.0) + 0.1)

    def score(self, text: str) -> float:
        ratio = self.ratio
        return sum(ratio[p] for p in zip("^" + text, text, strict=False)) / max(1, len(text))


@cache
def models() -> MarkovPair:
    return MarkovPair(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base rules."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates with letters and digits that the random model explains better; of one that base spans touch, the parts of 16 characters and more beside them."""
    pair, found = models(), []
    for m in CANDIDATE.finditer(text):
        at, parts = m.start(), []
        for a, _, b in sorted(taken):
            if a < m.end() and at < b:
                parts.append((at, a))
                at = b
        for a, b in [*parts, (at, m.end())]:
            s = text[a:b]
            if b - a >= 16 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and pair.score(s) > pair.threshold:
                found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base))
                kinds = [k for _, k, _ in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                rows.append((*row, redact(text, spans)) if keep_text else row)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (5 + keep_text)
            arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["redacted"] * keep_text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return run


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans and, if asked for, the redacted text.

    Null texts count as empty: no spans, the digest of the empty string. Every row is scanned by itself, so repeated rows
    give repeated results, and there is no shuffle.
    """
    return texts(docs).mapInArrow(_scan(keep_text), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * keep_text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same documents and columns with their secrets replaced by [SECRET] and n_chars set anew where it exists.

    A null text stays null. Columns of any name and type pass through untouched.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for value in batch.column(at):
                text = value.as_py()
                if text is not None:
                    base = base_spans(text)
                    text = redact(text, base + random_spans(text, base))
                new.append(text)
            yield batch.set_column(at, "text", pa.array(new, batch.column(at).type))

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
