"""Operator 12 against all pairs."""

import random

import numpy as np
import pytest

from boxloom.llm import hardneg, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, label int, vector array<bigint>, r int, block int, windows int"
MANY = hardneg.HardNegatives(every=10, block=7, shard=23, band=3)


def brute(rows, config):
    """rows of (id, label, vector), nulls left out."""
    order = lambda x: (-x[1], x[2] is None, x[2] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or i % config.every:
            continue
        others = sorted(((n, dot(v, r[2]), r[0], r[1]) for n, r in enumerate(rows) if n != k), key=order)
        for _, top, p, _ in [x for x in others if x[3] == label][: config.positives]:
            inside = [x for x in others if x[3] != label and config.low * top <= 100 * x[1] <= config.high * top]
            out += [(i, p, n, x[2], top, x[1]) for n, x in enumerate(inside[: config.negatives], 1)]
    return sorted(out, key=str)


def made(seed, n=150, wide=8, spread=40):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(3), [rng.randrange(-spread, spread) + (spread if rng.random() < 0.4 else 0) for _ in range(wide)]) for k in range(n)]
    return rows + rows[10:12] + [(40, 1, rows[40][2]), (None, 2, rows[0][2]), (500, 0, [0] * wide), (510, 1, []), (520, 2, [1, 2]), (77, 9, [50] * wide), (530, 8, [1] * wide)]


@pytest.mark.parametrize("config", [MANY, hardneg.HardNegatives(every=10), hardneg.HardNegatives(every=10, shard=40, low=-50, high=120, negatives=3)], ids=["blocks", "whole", "wide windows"])
def test_op12_brute_force(spark, config):
    rows = made(4)
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in [*rows, (600, None, [1] * 8), (610, 1, None), (620, 1, [1, None])]], SCHEMA)
    assert sorted((tuple(r) for r in hardneg.hard_negatives(frame, config).collect()), key=str) == brute(rows, config)


def test_op12_large_numbers(spark):
    rows = [(i, label, [x * 2**22 + 1 for x in v]) for i, label, v in made(6, 60)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in hardneg.hard_negatives(frame, MANY).collect()), key=str) == brute(rows, MANY)


def test_op12_given_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(np.array(r.embedding, float) * 256).astype(int).tolist()) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_hard_negatives(spark, SF).collect()), key=str)
    assert got and got == brute(rows, hardneg.HardNegatives())


def test_op12_nothing(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(100, 1, [1, 2], 0, 0, 0)], SCHEMA)).count() == 0


def test_op12_rows_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, 9, [0.5, -0.001]), (1, 3, [nan]), (2, 3, [inf]), (3, 3, [None]), (4, None, [1.0]), (5, 3, None), (None, 4, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert sorted((tuple(r) for r in hardneg.shifted(frame).collect()), key=str) == [(7, 0, [128, -1]), (None, 4, [256])]


@pytest.mark.parametrize("seed", range(8))
def test_op12_index_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(200, 20)).round(2) * 100 * rng.exponential(size=20)
    queries_ = rows[:9]
    index = hardneg.Index(rows, 4)
    asked = queries_[:, index.dims]
    exact = queries_ @ rows.T
    least = np.quantile(exact, rng.uniform(0.5, 0.999), axis=1)
    q, x, score = index.above(asked, index.norms(asked), least, np.ones(exact.shape, bool))
    assert np.allclose(score, exact[q, x])
    assert set(zip(*np.nonzero(exact >= least[:, None]), strict=True)) <= set(zip(q.tolist(), x.tolist(), strict=True))
    assert len(q) < exact.size
