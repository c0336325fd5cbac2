"""Seeds folded in pairs of blocks against brute force."""

import random
from collections import Counter, defaultdict
from statistics import median

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from strandline.operators import seeding
from strandline.plans import library

K, STEP = 6, 3


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [(i, base[(at := rng.randrange(200)) : at + 40] + "".join(rng.choice("ACGT") for _ in range(30)) + base[:20]) for i in range(40)]
    # a key of two sequences, one without windows, no key, another letter, a letter of two bytes
    return [*rows, (3, base[50:120]), (50, "AC"), (51, None), (None, base[:60]), (52, base[10:40] + "N" + base[60:90]), (53, "é" + base[100:140])]


@pytest.fixture(scope="module")
def seeds(texts):
    windows = [(i, p, s[p : p + K]) for i, s in texts for p in range(len(s or "") - K + 1) if not set(s[p : p + K]) - set("ACGT")]
    index = defaultdict(list)
    for i, p, kmer in windows:
        if p % STEP == 0:
            index[kmer].append((i, p))
    limit = max(8, 2 * sum(map(len, index.values())) / len(index))
    assert any(len(x) > limit for x in index.values())
    return [(q, t, pos - qpos, qpos) for q, qpos, kmer in windows for t, pos in index[kmer] if len(index[kmer]) <= limit and None not in (q, t) and q != t]


@pytest.mark.parametrize("block", [600, 1 << 25])
def test_folds(spark, texts, seeds, block, monkeypatch):
    monkeypatch.setattr(seeding, "BLOCK", block)
    frequent = seeding.frequent_kmers
    monkeypatch.setattr(seeding, "frequent_kmers", lambda *a: frequent(*a, factor=2, least=8))
    frame = spark.createDataFrame(texts, "id long, seq string")
    groups = defaultdict(list)
    for q, t, d, qpos in seeds:
        groups[q, t, d].append(qpos)
    assert sorted(map(tuple, seeding.seed_counts(frame, K, STEP).collect())) == sorted((*k, n) for k, n in Counter((q, t) for q, t, _, _ in seeds).items())
    want = sorted((*k, len(set(v)), min(v), max(v), float(median(v))) for k, v in groups.items() if len(set(v)) >= 2)
    assert sorted(map(tuple, seeding.seed_diagonals(frame, K, STEP).collect())) == want
    assert sorted(map(tuple, seeding.shared_diagonals(frame, K, STEP, 20).collect())) == sorted(k for k, v in groups.items() if min(v) < 20 <= max(v))
    bases, at = Counter(), {}
    for (q, t, d), v in sorted(groups.items()):
        at[q, t] = d if d > at.get((q, t), -(10**9)) + 12 else at[q, t]
        bases[q, t, at[q, t]] += len(v)
    assert sorted(map(tuple, seeding.seed_bases(frame, K, STEP).collect())) == sorted((*k, n) for k, n in bases.items())


def test_small_parts(texts, seeds, monkeypatch):
    """However the queries and their seeds are cut, a query key's seeds come at once."""
    monkeypatch.setattr(seeding, "PART", 50)
    monkeypatch.setattr(seeding, "SEEDS", 7)
    rows = sorted(((i, s or "") for i, s in texts if i is not None), key=lambda x: x[0])
    block = seeding._Block(pa.array([{"id": i, "seq": s} for i, s in rows], pa.struct([("id", pa.int64()), ("seq", pa.string())])), K)
    index = Counter(s[p : p + K] for _, s in texts for p in range(0, len(s or "") - K + 1, STEP))
    kept = {k for k, n in index.items() if n <= max(8, 2 * sum(index.values()) / len(index))}
    codes = sorted(sum("ACGT".index(c) * 4 ** (K - 1 - j) for j, c in enumerate(k)) for k in index if k not in kept and not set(k) - set("ACGT"))
    found, seen = [], set()
    for q, t, qpos, pos in seeding._met(block, block, STEP, seeding.np.array(codes, "int64")):
        assert not seen & set(q.tolist())
        seen |= set(q.tolist())
        found += [(block.ids[a].as_py(), block.ids[b].as_py(), d - c, c) for a, b, c, d in zip(q.tolist(), t.tolist(), qpos.tolist(), pos.tolist(), strict=True)]
    assert len(seen) > 5 and sorted(found) == sorted(seeds)


def test_wide_numbers():
    """Values that one packed number has no room for."""
    np = seeding.np
    pair, diagonal, qpos = np.array([1 << 40, 3, 1 << 40, 3]), np.array([1 << 21, -(1 << 21), -5, 7]), np.array([1, 9, 4, 2])
    assert [x.tolist() for x in seeding._sorted(pair, diagonal, qpos)] == [[3, 3, 1 << 40, 1 << 40], [-(1 << 21), 7, -5, 1 << 21], [9, 2, 4, 1]]
    assert [x.tolist() for x in seeding._ordered(np.array([1 << 61, 5, 6]), 62)] == [[5, 6, 1 << 61], [1, 2, 0]]


@pytest.mark.parametrize("name", ["diag_intersect", "kmer_seed_join", "collapse_diag", "diagonals"])
def test_no_seed_is_shuffled(spark, name):
    folder = "/root/testdata/sf0.001"
    frame = library.queries()[name](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan for x in ("hashpartitioning(query", "hashpartitioning(kmer", "SortMergeJoin", "BroadcastNestedLoop"))
    frame.select(F.lit(1)).count()
