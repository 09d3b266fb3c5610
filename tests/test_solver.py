"""The solver on tables against Spark ML's and against its objective."""

import math
import random

import numpy as np
from siftwire.operators import grams
from siftwire.operators import metrics as mt
from siftwire.operators import solver
from siftwire.plans import jobs
from siftwire.sources.sinks import shared_dir


def problem(n=200, size=30, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, size)) * (rng.random((n, size)) < 0.3)
    y = (x @ rng.normal(size=size) + 0.3 * rng.normal(size=n) > 0).astype(float)
    return x, y, rng.uniform(0.5, 2, n)


def objective(w, x, y, weight, c):
    z = x @ w[:-1] + w[-1]
    return (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum() + (w @ w) / (2 * c * weight.sum())


def least(x, y, weight, c):
    """Newton steps on the dense problem."""
    one = np.hstack([x, np.ones((len(x), 1))])
    w, total = np.zeros(one.shape[1]), weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        g = one.T @ (weight * (p - y)) / total + w / (c * total)
        h = (one.T * (weight * p * (1 - p))) @ one / total + np.eye(len(w)) / (c * total)
        w = w - np.linalg.solve(h, g)
    return w


def test_coefficients_reach_the_least_objective(spark):
    x, y, weight = problem()
    rows = spark.createDataFrame([(i, int(y[i]), float(weight[i])) for i in range(len(y))], "msg_id long, label int, weight double")
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "msg_id long, idx long, x double")
    table, bias = solver.fit(cells, rows, shared_dir(spark, "solver"), c=10.0, max_iter=40)
    w = np.zeros(x.shape[1] + 1)
    for r in table.collect():
        w[r.idx] = r.w
    w[-1] = bias
    best = least(x, y, weight, 10.0)
    assert objective(w, x, y, weight, 10.0) - objective(best, x, y, weight, 10.0) < 1e-5
    assert np.abs(w - best).max() < 0.05 * np.abs(best).max()


def test_direction_is_the_two_loop_one():
    rng = np.random.default_rng(2)
    h = rng.normal(size=(8, 8))
    h = h @ h.T + np.eye(8)
    s = [rng.normal(size=8) for _ in range(3)]
    y = [h @ v for v in s]
    g = rng.normal(size=8)
    basis = np.array([*s, *y, g])
    q, alpha = g.copy(), []
    for a, b in zip(reversed(s), reversed(y), strict=True):
        alpha.append(a @ q / (a @ b))
        q -= alpha[-1] * b
    q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
    for a, b, k in zip(s, y, reversed(alpha), strict=True):
        q += (k - b @ q / (a @ b)) * a
    assert np.allclose(solver.step(basis @ basis.T, 3) @ basis, -q)
    assert solver.step(np.ones((1, 1)), 0).tolist() == [-1.0]


def test_both_solvers_train_alike(spark):
    rng = random.Random(3)
    words = ["win", "cash", "prize", "lunch", "see", "you", "call", "home", "free", "note"]
    rows = []
    for i in range(160):
        label = i % 2
        text = " ".join(rng.choice(words[:3] if label and rng.random() < 0.5 else words) for _ in range(8))
        rows.append((i, text, label, f"s{i % 2}"))
    df = spark.createDataFrame(rows, "msg_id long, text string, label int, source string")
    models, reports = [], []
    for dense in (10**6, 0):
        model, held = jobs.train(df, shared_dir(spark, "alike"), max_iter=25, dense_terms=dense)
        models.append({(r.kind, r.gram): r.w for r in model.weights.collect()})
        reports.append(sorted(map(tuple, mt.by_source(held).collect())))
    assert models[0].keys() == models[1].keys() and len(models[0]) > 50
    a, b = (np.array([m[k] for k in sorted(models[0])]) for m in models)
    assert a @ b / math.sqrt((a @ a) * (b @ b)) > 0.995
    assert reports[0] == reports[1]


def test_blocks_multiply_like_their_cells():
    rng = np.random.default_rng(4)
    row, idx = np.divmod(np.unique(rng.integers(0, 40 * 500, 900)), 500)
    row, idx = row[row != 7], idx[row != 7]  # a row without cells
    kind, tf, idf = (idx > 300).astype(np.int8), rng.integers(1, 5, len(row)), 1 + (idx % 7) / 10
    raw = (np.log(tf) + 1) * idf
    x = raw / np.sqrt(np.bincount(row * 2 + kind, raw * raw))[row * 2 + kind]
    mixed = rng.permutation(len(row))
    for more in ((), (tf[mixed], idf[mixed], kind[mixed])):
        known, found = grams.block(40, row[mixed], idx[mixed], x[mixed], *more)
        assert grams.indices(known).tolist() == np.unique(idx).tolist()
        cells, place = grams.Cells(found, 40), np.searchsorted(np.unique(idx), idx)
        by_place, by_row = rng.normal(size=len(np.unique(idx))), rng.normal(size=40)
        assert np.allclose(cells.sums(by_place), np.bincount(row, x * by_place[place], 40))
        assert np.allclose(cells.slopes(by_row), np.bincount(place, x * by_row[row]))


def test_rounds_leave_no_tables_and_rows_without_features_count(spark, tmp_path):
    x, y, weight = problem()
    x[:20] = 0
    rows = spark.createDataFrame([(i, int(y[i]), float(weight[i])) for i in range(len(y))], "msg_id long, label int, weight double")
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "msg_id long, idx long, x double")
    table, bias = solver.fit(cells, rows, str(tmp_path), c=10.0, max_iter=40)
    w = np.zeros(x.shape[1] + 1)
    for r in table.collect():
        w[r.idx] = r.w
    w[-1] = bias
    assert objective(w, x, y, weight, 10.0) - objective(least(x, y, weight, 10.0), x, y, weight, 10.0) < 1e-5
    left = [p.name for p in tmp_path.iterdir()]
    assert sum(n.startswith("state-") for n in left) == 1 and sum(n.startswith("moving-") for n in left) == 1
