"""Dynamic programming and other ordered folds, in Arrow batches: chaining, banded alignment, gap placement, trimming, adapters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Scores of the banded alignment (high-quality reads) and of chaining.
MATCH, MISMATCH, OPEN, EXTEND = 1, -3, -8, -3
DIAGONAL_COST, DIAGONAL_LIMIT, EXONS = 10_000, 100_000, 3
NEVER = -(10**9)


def chain(first: np.ndarray, last: np.ndarray, diagonal: np.ndarray, score: np.ndarray, exons: int = EXONS) -> tuple[float, list[int]]:
    """The best chain of up to so many segments in query order: a step costs its change of diagonal / 10000 and what the segments overlap.

    Returns its score and the segments' places. Steps to a lower diagonal, or over more than 100 kb, are not taken. Ties keep the earlier segment.
    """
    order = np.lexsort((diagonal, last, first))
    f, l, d, s = (x[order].astype(float) for x in (first, last, diagonal, score))
    n = len(order)
    best, back = np.full((exons, n), -np.inf), np.full((exons, n), -1)
    best[0] = s
    for k in range(1, exons):
        for j in range(1, n):
            step = d[j] - d[:j]
            value = np.where((step >= 0) & (step < DIAGONAL_LIMIT) & (l[:j] < l[j]), best[k - 1, :j] - step / DIAGONAL_COST - np.maximum(0, l[:j] - f[j] + 1), -np.inf)
            i = int(value.argmax())
            if value[i] > -np.inf:
                best[k, j], back[k, j] = value[i] + s[j], i
    k, j = np.unravel_index(int(best.argmax()), best.shape)
    found, path = float(best[k, j]), []
    while j >= 0:
        path.append(int(order[j]))
        k, j = k - 1, back[k, j] if k > 0 else -1
    return found, path[::-1]


def chain_segments(segments: DataFrame, exons: int = EXONS) -> DataFrame:
    """(query, target, score, segments): the best chain of each query and target from rows (query, target, diagonal, first, last, n).

    One group holds the diagonals of one query on one target: without_frequent() bounds them before the seeds are made.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        score, path = chain(*(group[c].to_numpy() for c in ("first", "last", "diagonal", "n")), exons)
        at = [f"{int(r.first)}-{int(r.last)}@{int(r.diagonal)}" for r in group.iloc[path].itertuples()]
        return pd.DataFrame({"query": [group["query"].iloc[0]], "target": [group["target"].iloc[0]], "score": [round(score, 6)], "segments": [at]})

    return segments.groupBy("query", "target").applyInPandas(run, "query long, target long, score double, segments array<string>")


def banded(query: str, genome: str, band: int = 6, match: int = MATCH, mismatch: int = MISMATCH, open_: int = OPEN, extend: int = EXTEND) -> tuple[int, str]:
    """Score and CIGAR of the best end-to-end alignment within a band around the corner-to-corner diagonals; a gap of n costs open + n extend.

    A row's matches and downward gaps are vectors; its rightward gaps are a running maximum. Equal ways prefer a match, then
    an insertion.
    """
    n, m = len(query), len(genome)
    low, high = min(0, m - n) - band, max(0, m - n) + band
    q, g = np.frombuffer(query.encode(), np.uint8), np.frombuffer(genome.encode(), np.uint8)
    j = np.arange(m + 1)
    h = np.where(j > 0, open_ + extend * j, 0).astype(np.int64)
    h[j > high] = NEVER
    down = np.full(m + 1, NEVER, np.int64)
    rows, downs, rights = [h], [down], [np.where(j > 0, h, NEVER)]
    for i in range(1, n + 1):
        down = np.maximum(rows[-1] + open_ + extend, down + extend)
        diagonal = np.full(m + 1, NEVER, np.int64)
        diagonal[1:] = rows[-1][:-1] + np.where(g == q[i - 1], match, mismatch)
        base = np.maximum(diagonal, down)
        outside = (j - i < low) | (j - i > high)
        base[outside] = NEVER
        run = np.maximum.accumulate(base - extend * j)
        right = np.full(m + 1, NEVER, np.int64)
        right[1:] = run[:-1] + open_ + extend * j[1:]
        h = np.maximum(base, right)
        h[outside] = NEVER
        rows, downs, rights = [*rows, h], [*downs, down], [*rights, right]
    ops, i, k, state = [], n, m, "H"
    while i or k:
        if state == "H":
            if i and k and rows[i][k] == rows[i - 1][k - 1] + (match if query[i - 1] == genome[k - 1] else mismatch):
                ops.append("M")
                i, k = i - 1, k - 1
                continue
            state = "I" if i and rows[i][k] == downs[i][k] else "D"
        if state == "I":
            opened = downs[i][k] == rows[i - 1][k] + open_ + extend
            ops.append("I")
            i -= 1
        else:
            opened = k == 1 or rights[i][k] == rows[i][k - 1] + open_ + extend
            ops.append("D")
            k -= 1
        state = "H" if opened else state
    return int(rows[n][m]), run_lengths("".join(reversed(ops)))


def run_lengths(ops: str) -> str:
    out, i = [], 0
    while i < len(ops):
        j = i
        while j < len(ops) and ops[j] == ops[i]:
            j += 1
        out.append(f"{j - i}{ops[i]}")
        i = j
    return "".join(out)


def align_pairs(pairs: DataFrame, band: int = 6) -> DataFrame:
    """(id, score, cigar) of rows (id, query, genome). A row needs memory in proportion to the product of its lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [banded(q or "", g or "", band) for q, g in zip(batch["query"], batch["genome"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "score": [s for s, _ in found], "cigar": [c for _, c in found]})

    return pairs.select("id", "query", "genome").mapInPandas(run, "id long, score long, cigar string")


def best_break(query: str, left: str, right: str, least: int = 4) -> tuple[int, int]:
    """(place, mismatches): where a query passes from one genome piece to another of its length, with the fewest mismatches in all.

    left and right are the genome along the two diagonals; both sides keep least bases. The first of equal places counts; -1 if none is possible.
    """
    q, a, b = (np.frombuffer(x.encode(), np.uint8) for x in (query, left, right))
    n = min(len(q), len(a), len(b))
    if n < 2 * least:
        return -1, -1
    before = np.concatenate([[0], np.cumsum(q[:n] != a[:n])])
    after = np.concatenate([np.cumsum((q[:n] != b[:n])[::-1])[::-1], [0]])
    total = (before + after)[least : n - least + 1]
    at = int(total.argmin())
    return at + least, int(total[at])


def splice_break(query: str, left: str, right: str, slack: int = 0) -> tuple[int, int, str]:
    """As best_break() between exons: left goes on past its end and right starts before its place, so that the intron's ends can be read.

    Among places with the fewest mismatches (or slack more) a canonical intron wins: GT-AG before GC-AG before AT-AC, both strands.
    left[i] and right[i] lie across query[i]; the intron begins at left[place] and ends before right[place].
    """
    n = min(len(query), len(left) - 2, len(right))
    q, a, b = (np.frombuffer(x.encode(), np.uint8) for x in (query, left, right))
    before = np.concatenate([[0], np.cumsum(q[:n] != a[:n])])
    after = np.concatenate([np.cumsum((q[:n] != b[:n])[::-1])[::-1], [0]])
    total = before + after
    ranks = {("GT", "AG"): 0, ("CT", "AC"): 0, ("GC", "AG"): 1, ("CT", "GC"): 1, ("AT", "AC"): 2, ("GT", "AT"): 2}
    options = []
    for at in range(2, n + 1):
        if total[at] <= total.min() + slack:
            ends = left[at : at + 2], right[at - 2 : at]
            options.append((ranks.get(ends, 3), int(total[at]), at, "-".join(ends)))
    if not options:
        return int(total.argmin()), int(total.min()), ""
    _, mism, at, ends = min(options)
    return at, mism, ends


def place_indels(rows: DataFrame, least: int = 4) -> DataFrame:
    """(id, place, mism) of rows (id, query, left, right)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [best_break(*x, least) for x in zip(batch["query"], batch["left"], batch["right"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "place": [p for p, _ in found], "mism": [m for _, m in found]})

    return rows.select("id", "query", "left", "right").mapInPandas(run, "id long, place long, mism long")


def adapter_offset(one: str, two: str, longest: int = 20, mism: int = 1) -> int:
    """How many bases to take off the end of a read and the start of its mate (already turned): the offset with the most of 3 matches - mismatches.

    Only overlaps of more than longest bases with at most mism mismatches count; the matches counted include the offset. 0 for none.
    """
    a, b = np.frombuffer(one.encode(), np.uint8), np.frombuffer(two.encode(), np.uint8)
    n, best, at = min(len(a), len(b)), 0, 0
    for j in range(n - longest):
        wrong = int((a[: n - j] != b[j:n]).sum())
        if wrong <= mism and 3 * (n - wrong) - wrong > best:
            best, at = 3 * (n - wrong) - wrong, j
    return at


def pair_overlap(one: str, two: str, least: int = 10, mism: int = 1) -> int:
    """The longest end of one that equals a start of two, but for mism mismatches; 0 below least."""
    a, b = np.frombuffer(one.encode(), np.uint8), np.frombuffer(two.encode(), np.uint8)
    for n in range(min(len(a), len(b)), least - 1, -1):
        if int((a[len(a) - n :] != b[:n]).sum()) <= mism:
            return n
    return 0


def trim_end(same: np.ndarray, penalty: int = -3) -> int:
    """Length that stays of an alignment (true at matches) when its far end is trimmed: a walk of +1 and penalty that starts anew below 0; ties keep more. A penalty of 0 trims nothing."""
    if penalty == 0:
        return len(same)
    score = best = keep = 0
    for i, match in enumerate(same):
        score += 1 if match else penalty
        if score < 0:
            score = 0
        elif score >= best and match:
            best, keep = score, i + 1
    return keep


def good_stretch(same: np.ndarray, good: float = 0.99, bad: float = 0.6, stay: float = 0.95) -> np.ndarray:
    """The likelier state (true: good) at each place, from a model of two states by how often bases match in them."""
    emit = np.log(np.where(np.asarray(same, bool)[:, None], [good, bad], [1 - good, 1 - bad]))
    move = np.log(np.array([[stay, 1 - stay], [1 - stay, stay]]))
    score, back = np.log([0.5, 0.5]), []
    for e in emit:
        options = score[:, None] + move
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + e
    state, out = int(score.argmax()), []
    for b in reversed(back):
        out.append(state == 0)
        state = int(b[state])
    return np.array(out[::-1], bool)
