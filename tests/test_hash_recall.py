"""Recall of the hash search against brute force."""

import numpy as np

from sparkdr.plans import registered


def test_hash_search_recalls_the_exact_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    out = registered.hash_search_top10(spark, sf).collect()
    recalls = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits = sorted((r for r in out if r.qid == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in hits] == list(range(1, 11)) and np.allclose([r.score for r in hits], [score[ids == r.id][0] for r in hits])
        recalls.append(len({r.id for r in hits} & set(ids[np.argsort(-score)[:10]].tolist())) / 10)
    assert np.mean(recalls) >= 0.9
