"""Codes of vectors miss no pair, and groups of near copies are whole however they are dealt."""

import numpy as np
import pytest

from cladeframe.llm.near_vectors import encode, may_link, near_vectors, plan_tables

COSINE = 0.93


def _cosines(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize("dim", [1, 2, 3, 16, 64, 700])
@pytest.mark.parametrize("spike", [0, 30])
def test_codes_bound_the_cosine(dim, spike):
    rng = np.random.default_rng((dim, spike))
    base = rng.normal(size=(40, dim))
    base[:, 0] += spike
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.3, 0.39, 0.6)])
    x /= np.abs(x).max(1, keepdims=True)
    may = may_link(encode(x), COSINE)
    assert not ((_cosines(x) >= COSINE) & ~may).any()
    if dim >= 16 and not spike:
        assert may.sum() < 1.3 * (_cosines(x) >= COSINE - 0.05).sum()


def test_plan_reaches_the_recall():
    alike = 1 - np.arccos(COSINE) / np.pi
    sizes = [0, 1, 500, 50_000, 10**9]
    for vectors in sizes:
        bits, tables = plan_tables(vectors)
        assert 1 - (1 - alike**bits) ** tables >= 0.999
    assert [plan_tables(v)[1] for v in sizes] == sorted(plan_tables(v)[1] for v in sizes)


@pytest.fixture(scope="module")
def crowd():
    """Two labels: one large group of different near copies, a chain, and vectors by themselves."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    near = centre + rng.normal(size=(300, 16)) * 0.12
    angles = np.arange(40) * 0.3
    chain = np.zeros((40, 16))
    chain[:, 0], chain[:, 1] = np.cos(angles), np.sin(angles)
    alone = rng.normal(size=(400, 16))
    x = np.concatenate([near, chain, alone]).astype(np.float32)
    return x, rng.permutation(len(x)), (np.arange(len(x)) % 20 == 0).astype(int)


def _expected(x, ids, label):
    linked = (_cosines(x.astype(float)) >= COSINE) & (label[:, None] == label[None, :])
    root = ids.copy()
    while True:
        new = np.where(linked, root[None, :], root.max()).min(1)
        if (new == root).all():
            return {int(i): (int(n) - 1, int(r)) for i, n, r in zip(ids, linked.sum(1), root, strict=True)}
        root = new


@pytest.mark.parametrize("block", [7, 512])
def test_groups_are_whole(spark, crowd, block):
    x, ids, label = crowd
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, label, strict=True)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    found = near_vectors(vectors, block_vectors=block).collect()
    want = _expected(x, ids, label)
    assert len(found) == len(want)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_equal_ids_and_labels_of_text(spark):
    rows = [
        (1, [1.0, 0.0, 0.1], "a"), (1, [1.0, 0.0, 0.2], "a"), (2, [0.0, 1.0, 0.0], "a"),
        (3, [1.0, 0.0, 0.1], "b"), (4, [1e300, 0.0, 1e299], "b"), (5, [-1.0, 0.0, -0.1], "b"),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(vectors).collect())
    # Vectors of one id share their links, as the sum.
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5)]
