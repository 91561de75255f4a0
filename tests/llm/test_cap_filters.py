import numpy as np
import pytest
from framewright.llm import cap_filters as C

from .conftest import SF


def brute(rows, cosine):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(linked, root[None], 1 << 60).min(1))
        if (new == root).all():
            return linked, dict(zip(ids, root.tolist(), strict=True))
        root = new


@pytest.mark.parametrize("block", [15, 40, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(1)
    near = [(200_000 + 15 * r.vec_id + i, (np.array(r.embedding) + rng.normal(size=64) * 0.003 * i).tolist(), 0) for r in vectors.where("vec_id < 20").collect() for i in range(15)]
    vectors = vectors.union(vectors.where("vec_id < 5").selectExpr("vec_id + 100000", "embedding", "label")).union(spark.createDataFrame(near, vectors.schema))
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    linked, root = brute(rows, 0.9)
    got = {r.vec_id: r for r in C.op10_cap_filters(vectors).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.93 * linked.sum() <= found <= linked.sum() and linked.sum() > 500
    assert sum(got[i].component_id == root[i] for i in root) >= 0.97 * len(root)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("codes", [16, 64, 256, 700])
def test_recall_at_the_limit(codes):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + 0.19**0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    caps = C.Caps(64, codes, 0.9)
    lists = []
    for v in (x, y):
        rows, names = caps.passed(v)
        lists.append([set(p.tolist()) for p in np.split(names, np.flatnonzero(np.diff(rows)) + 1)])
        first, second = caps._products(v[:20])
        every = (first[:, :, None] + second[:, None, :]).reshape(20, -1)
        assert all(set(np.flatnonzero(every[i] >= caps.threshold)) | {every[i].argmax()} == lists[-1][i] for i in range(20))
    assert np.mean([bool(a & b) for a, b in zip(*lists, strict=True)]) >= 0.97


def test_highest_shared_threshold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = rng.normal(size=(2, 2, 30))
        every = [(v[0][:, None] + v[1][None]).ravel() for v in (x, y)]
        assert abs(C.Caps._shared(tuple(x), tuple(y)) - np.minimum(*every).max()) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (10, [1.0, -1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rep int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in C.op10_cap_filters(vectors).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert C.op10_cap_filters(vectors.limit(0)).count() == 0


def test_links_are_those_of_pairs_that_share_a_filter(spark, monkeypatch):
    """Counts equal, pair for pair, what the filters let meet, whether filters are hot or not; ids repeat and vectors too."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([b + rng.normal(size=(30, 16)) * 0.25 for b in base]).astype(np.float32)
    x = np.concatenate([x, x[:7]])
    ids = np.concatenate([np.arange(365), [0, 365]])
    caps = C.Caps(16, 20, 0.9)
    raw = [v.tobytes() for v in x]
    rows, names = caps.passed(C._unit(raw, np.dtype("<f4")))
    lists = [set(p.tolist()) for p in np.split(names, np.flatnonzero(np.diff(rows)) + 1)]
    unit = C._unit(raw, np.dtype("<f4"))
    cosine = unit @ unit.T >= 0.9
    want = [sum(bool(i != j and (cosine[i, j] and lists[i] & lists[j] or raw[i] == raw[j])) for j in range(len(x))) for i in range(len(x))]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    for block in (10, 50, 1024):
        monkeypatch.setattr(C, "BLOCK", block)
        got = sorted((r.vec_id, r.n_links) for r in C.near_vectors(df, codes=20).collect())
        assert got == sorted(zip(ids.tolist(), want, strict=True)), block
    assert sum(want) > 3000
