import math
import random

import numpy as np
import pytest

from waymark.llm import topk_search as M


def brute(rows):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, d):
    return sorted(tuple(r) for r in M.op1_topk_search(spark, d).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_against_brute_force(spark, folder, spread):
    r = random.Random(3)
    base = [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, [(b if i % 3 else 0) + r.gauss(0, spread) * (1 + i % 7) for b in base], 0) for i in range(600)]
    assert run(spark, folder(embeddings=rows)) == brute(rows)


def test_odd_rows(spark, folder):
    rows = [(0, [1.0, 2.0], 1), (50, [0.0, 0.0], 1), (100, None, 1), (150, [float("nan"), 1.0], 1), (200, [None, 1.0], 1), (None, [9.0, 9.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0, 3.0], 1), (4, [], 1), (5, [float("inf"), 0.0], 1), (6, [-5.0, -5.0], 1), (7, [3e5, 3e5], 1)]
    assert run(spark, folder(extra=True, embeddings=rows)) == brute(rows)


def test_repeated_ids(spark, folder, monkeypatch):
    monkeypatch.setattr(M, "QUERY_BLOCK", 4)
    monkeypatch.setattr(M, "VECTOR_BLOCK", 16)
    r = random.Random(5)
    rows = [(i % 130, [r.gauss(0, 1 + i % 5) for _ in range(6)], 0) for i in range(400)]
    assert run(spark, folder(embeddings=rows + rows[:60])) == brute(rows + rows[:60])


def test_empty(spark, folder):
    assert run(spark, folder(embeddings=[])) == []
    assert run(spark, folder(embeddings=[(1, [1.0], 0)])) == []


def test_pruning_keeps_all_that_matters():
    r = np.random.default_rng(1)
    v = np.floor(r.normal(0, 200, (500, 6)))
    norms = np.linalg.norm(v, axis=1)
    for q in v[:40]:
        scores = v @ q
        for least in np.sort(scores)[[-1, -5, -50]]:
            kept = M.candidates(q, np.linalg.norm(q), least, v, norms)
            assert set(np.flatnonzero(scores >= least)) <= set(kept)
