"""Vector links and search at sizes where hashing and pruning matter."""

import numpy as np
import pandas as pd
import pytest

from riskweave.llm import ann, embedding_dedup, graph, vectors


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def clustered(seed, groups, size, dims=48, spread=0.04):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    sizes = rng.integers(1, size, groups)
    sizes[0] = 40 * size  # one group far larger than the others
    x = np.repeat(centres, sizes, axis=0)
    return x + spread * rng.standard_normal(x.shape) * np.sqrt(dims) * rng.random((len(x), 1))


def truth(x, similarity=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= similarity
    np.fill_diagonal(linked, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], len(x)).min(axis=1))
        if (new == low).all():
            return linked.sum(axis=1), low
        low = new


@pytest.mark.parametrize(("block", "small"), [(256, 16), (32, 2)])
def test_links_equal_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    x = clustered(1, 150, 12)
    links, low = truth(x)
    got = embedding_dedup.deduplicate(frame(spark, x)).toPandas().set_index("vec_id").sort_index()
    wrong = got["n_links"].to_numpy() != links
    # A pair at just 0.9 is missed twice in a thousand.
    assert abs(links.sum() - got["n_links"].sum()) <= 0.002 * links.sum()
    assert (got["n_links"].to_numpy() <= links).all() and wrong.mean() < 0.1
    assert (got["component_id"].to_numpy() == low).mean() >= 0.995
    assert (got["kept"] == (got["component_id"] == got.index)).all()


@pytest.mark.parametrize("count", [500, 50_000])
def test_tables_hold_pairs_at_the_bound(count):
    rng = np.random.default_rng(count)
    a = vectors.unit(rng.standard_normal((1_000, 64)))
    b = rng.standard_normal((1_000, 64))
    b = vectors.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    projections, tables = embedding_dedup.design(count)
    met = (embedding_dedup.keys(a, projections, tables) == embedding_dedup.keys(b, projections, tables)).any(axis=1)
    assert met.mean() >= 0.99


def test_unrelated_vectors_meet_equally_often_at_any_size():
    meetings = []
    for n in (1_000, 5_000):
        x = np.random.default_rng(n).standard_normal((n, 64))
        found = embedding_dedup.keys(x, *embedding_dedup.design(n)).ravel()
        sizes = np.unique(found, return_counts=True)[1]
        meetings.append((sizes * (sizes - 1)).sum() / n)
    assert meetings[1] < 1.5 * meetings[0] and max(meetings) < 3 * embedding_dedup.MEETINGS


def test_very_large_and_small_parts(spark):
    x = np.array([[1e200, 0.0], [1e200, 1e199], [0.0, 1e-200], [1e-201, 1e-200], [1.0, -1.0]])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.deduplicate(frame(spark, x)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4)}
    near = vectors.cosines(x[[0, 2]], x[[1, 3]])
    assert near == pytest.approx([1 / np.sqrt(1.01)] * 2, abs=1e-15)


def test_rows_that_repeat_an_id_have_their_own_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.deduplicate(df).collect())
    assert got == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    assert embedding_dedup.deduplicate(df.limit(0)).count() == 0


def test_nothing_that_grows_with_the_vectors_is_broadcast(spark, monkeypatch):
    made = []
    for module in (embedding_dedup, graph):
        monkeypatch.setattr(module, "store", lambda df, label, kept=module.store: made.append(df) or kept(df, label))
    made.append(embedding_dedup.deduplicate(frame(spark, clustered(2, 20, 5))))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 5
    assert not any("Broadcast" in plan for plan in plans)


def test_a_task_returns_its_queries_best_only():
    rng = np.random.default_rng(3)
    q, x = rng.standard_normal((20, 16)), rng.standard_normal((500, 16))
    blocks = [
        {"q_ids": list(range(20)), "q_vectors": list(q), "ids": list(range(at, at + 100)), "vectors": list(x[at : at + 100])}
        for at in range(0, 500, 100)
    ]
    got = pd.concat(ann._compared([pd.DataFrame(blocks), pd.DataFrame(blocks[:1])], 6))
    assert len(got) == 20 * 6
    score = vectors.unit(q) @ vectors.unit(x).T
    for rep, found in got.groupby("rep"):
        assert set(found["id"]) == set(np.argsort(-score[rep])[:6])
