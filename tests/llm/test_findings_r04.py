"""Cases of FINDINGS_r04."""

import numpy as np

from cairn.llm import vectors


def test_vectors_without_a_partner_in_bound_enter_no_graph(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 64))
    x[2300:2390] = x[:90] + 0.17 * rng.normal(size=(90, 64))  # pairs around the threshold
    x[2390:] = x[100] + 0.02 * rng.normal(size=(10, 64))
    rows = spark.createDataFrame([(i, v.tolist(), i % 100 % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = vectors.unit(list(x))
    links = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2) & ~np.eye(len(x), dtype=bool)
    assert 20 < links.any(axis=1).sum() < 200
    placed, shards = [], vectors.shards
    monkeypatch.setattr(vectors, "shards", lambda classes, threshold: placed.append(classes.count()) or shards(classes, threshold))
    for chunk in (16384, 300):
        monkeypatch.setattr(vectors, "CHUNK", chunk)
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(rows).collect()}
        assert got == dict(enumerate(links.sum(axis=1)))
    assert max(placed) <= 400  # of 2400; before, all of them


def test_sketches_bound_similarities_from_above():
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 16, 64, 200):
        x = rng.normal(size=(300, d))
        x[200:] = x[:100] + 0.05 * rng.normal(size=(100, d))
        x = vectors.unit(list(x))
        s, chunk = vectors.sketches(x), rng.integers(0, 2, 300)
        sims = x @ x.T
        assert (s.astype(float) @ s.T.astype(float) >= sims - vectors.SLACK).all()
        np.fill_diagonal(sims, -2)
        for within in (chunk == 0, chunk < 0, chunk >= 0):
            met = (chunk[:, None] != chunk) | within[:, None] & within
            found = vectors.in_bound(s, chunk, within, 0.98)
            assert found[((sims >= 0.98) & met).any(axis=1)].all()
            if d >= 64:
                assert not found[((sims < 0.5) | ~met).all(axis=1)].any()
