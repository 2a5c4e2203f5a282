"""Every query gets its k nearest, also far from all other vectors."""

from __future__ import annotations

import numpy as np

from opscheck.llm.vector_search import VectorParameters, nearest

SCHEMA = "vec_id long, embedding array<double>"


def test_outliers_have_full_results(spark):
    random = np.random.default_rng(5)
    x = random.normal(0, 1, (1500, 8))
    x[::250] = random.normal(0, 1, (6, 8)) * 1000  # far vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    p = VectorParameters(list_size=20, max_probes=3, probe_ratio=1.01)
    found = {}
    for r in nearest(df, df.filter("vec_id % 20 = 0"), p).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(found) == 75 and all(sorted(a for a, _, _ in f) == list(range(1, 21)) for f in found.values())
    hits = 0
    for q, f in found.items():
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:20].tolist()) & {v for _, v, _ in f})
    assert hits >= 0.5 * 75 * 20  # so few lists are read here on purpose


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(7)], SCHEMA)
    got = nearest(df, df.filter("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(k, 7 - k) for k in range(1, 7)]
