"""Lattice near-duplicates and curve neighbours against brute force."""

import numpy as np
import pytest

from cohortlens.llm import hilbert, lattice


def _frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")


def _groups(seed=0, n=300, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    more = []
    for i in range(0, n, 6):
        for c in rng.uniform(0.94, 0.999, rng.integers(1, 8)):
            z = rng.normal(size=dim)
            z -= z @ x[i] * x[i]
            more.append((c * x[i] + np.sqrt(1 - c * c) * z / np.linalg.norm(z)) * rng.uniform(0.1, 9))
    return np.concatenate([x, more])


def test_nearest_is_the_closest_lattice_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    p = lattice.nearest(x)
    steps = lattice.neighbours()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    assert np.allclose(p.sum(1) % 2, 0) and np.allclose((2 * p) % 2 @ np.ones(8) % 8, 0)
    own = ((x - p) ** 2).sum(1)
    assert (own[:, None] <= ((x[:, None] - p[:, None] - steps[None]) ** 2).sum(2) + 1e-9).all()


def test_links_counts_and_components(spark):
    x = _groups()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = u @ u.T >= 0.95
    np.fill_diagonal(true, False)
    n = len(x)
    extra = [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [float("nan")] + [1.0] * 63, 0), (1003, [None] + [1.0] * 63, 0),
             (1004, [float("inf")] * 64, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (None, [1.0] * 64, 0),
             (2000, [float(v) for v in x[0]], 0), (2001, [float(v) for v in x[0]], 0)]
    out = {r.vec_id: r for r in lattice.near_duplicates(_frame(spark, x, extra)).collect()}
    assert len(out) == n + 9
    for i in range(1000, 1007):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    copies = 2 * true[0].astype(int)
    copies[0] = 2
    want = true.sum(1) + copies
    got = np.array([out[i].n_links for i in range(n)])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    assert out[2000].n_links == out[2001].n_links == out[0].n_links
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(true, root[None, :], n).min(1))
        if (new == root).all():
            break
        root = new
    agree = np.mean([out[i].component_id == root[i] for i in range(n)])
    assert agree >= 0.9 and all(root[out[i].component_id] == root[i] for i in range(n))
    assert lattice.near_duplicates(_frame(spark, x).limit(0)).count() == 0


def test_a_crowded_cell_is_cut_into_parts(spark):
    """Every two parts meet once: the same links and components as in one task."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.02, _groups(2, 60)])
    frame = _frame(spark, x, [(5000, [float(v) for v in x[0]], 0)])
    whole = sorted(map(tuple, lattice.near_duplicates(frame).collect()))
    for part_rows in (1, 40, 250):
        assert sorted(map(tuple, lattice.near_duplicates(frame, part_rows=part_rows).collect())) == whole


def test_a_pair_is_counted_once_in_a_hot_group(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.02, rng.normal(size=(100, 64))])
    out = lattice.near_duplicates(_frame(spark, x)).collect()
    links = np.array([r.n_links for r in sorted(out)])
    assert links.max() <= 399 and links[:400].mean() >= 0.97 * 399 and links[400:].max() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_visits_neighbouring_cells(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[50:60] = x[0]  # ties at distance 0
    out = hilbert.neighbours(_frame(spark, x), "vec_id % 100 = 0", 10, block_rows=256).collect()
    found, total = 0, 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in got)
        found, total = found + len({r.vec_id for r in got} & set(want.tolist())), total + 10
    assert found >= 0.9 * total


def test_few_and_odd_vectors(spark):
    extra = [(7, None, 0), (8, [0.0, 0.0], 0), (9, [float("nan"), 1.0], 0), (10, [1.0, None], 0), (None, [1.0, 1.0], 0)]
    frame = _frame(spark, np.array([[1.0, 0.0], [0.0, 1.0], [3.0, 4.0]]), extra)
    out = hilbert.neighbours(frame, "vec_id % 100 = 0", 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(0, 1, 1), (0, 2, 2)]
    assert hilbert.neighbours(frame.limit(0), "vec_id % 100 = 0").count() == 0


def _recall(out, x, ids, queries):
    found = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        found += len({r.vec_id for r in out if r.query_id == ids[q]} & set(want.tolist()))
    return found / (10 * len(queries))


def test_a_vector_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2100, 24))
    x[rng.permutation(2100)[:700]] = x[0]
    out = hilbert.neighbours(_frame(spark, x), "vec_id % 20 = 0", 10, block_rows=256).collect()
    assert _recall(out, x, np.arange(2100), range(0, 2100, 20)) >= 0.9
    hot = [q for q in range(0, 2100, 20) if (x[q] == x[0]).all()]
    assert _recall(out, x, np.arange(2100), hot) == 1


def test_repeated_ids_leave_no_gaps(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 8))
    out = hilbert.neighbours(_frame(spark, x, [(1, [float(v) for v in x[0] + 1e-3 * i], 0) for i in range(1, 30)]),
                             "vec_id = 0", 10).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 11)) and len({r.vec_id for r in out}) == 10


def test_a_few_huge_vectors_do_not_flatten_the_grid(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1e12
    x[8] *= -1e9
    out = hilbert.neighbours(_frame(spark, x), "vec_id % 20 = 0", 10, block_rows=256).collect()
    assert _recall(out, x, np.arange(2000), range(0, 2000, 20)) >= 0.9


def test_every_dimension_is_searched(spark):
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(1200, 24)), rng.normal(size=(600, 16))
    extra = [(5000 + i, [float(v) for v in r], 0) for i, r in enumerate(y)] + [(9000, [1.0], 0), (9001, [3.0], 0)]
    out = hilbert.neighbours(_frame(spark, x, extra), "vec_id % 20 = 0", 10, block_rows=256).collect()
    assert _recall(out, x, np.arange(1200), range(0, 1200, 20)) >= 0.9
    assert _recall(out, y, 5000 + np.arange(600), range(0, 600, 20)) >= 0.9
    assert [(r.vec_id, r.score) for r in out if r.query_id == 9000] == [(9001, 2.0)]
