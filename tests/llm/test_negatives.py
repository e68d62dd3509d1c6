"""Hard negatives against brute force: nulls, ties, copies, odd lengths, large numbers, small cells."""

import math

import brute
import check
import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, row string, q int"


def cases():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(900):
        x = centres[rng.integers(12)] * rng.uniform(0.2, 1) + rng.normal(size=16) * 0.3
        rows.append((i, (x / np.linalg.norm(x)).tolist(), int(rng.integers(4))))
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(40)]  # ties
    rows += [rows[100], rows[200], (None, rows[200][1], 1), (None, rows[200][1], 2), (1100, None, 1), (1200, rows[3][1], None)]
    rows += [(1300, [math.nan, *rows[4][1][1:]], 1), (1301, [None, *rows[4][1][1:]], 1), (1302, [math.inf], 2), (1400, [], 1), (1500, [0.5, 0.5], 2)]
    return rows + [(1600, [0.0] * 16, 3), (1700, [-c for c in rows[0][1]], 0)]


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).coalesce(1)
    got = negatives.hard_negatives(negatives.integer_vectors(df), F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("cell, block", [(4_000_000, 500_000), (800, 48)])
def test_hard_negatives(spark, cell, block):
    rows = cases()
    assert mined(spark, rows, cell_values=cell, anchor_values=block) == sorted(brute.hard_negatives(rows), key=str)


def test_large_numbers(spark):
    for scale in (1e2, 1e5):
        rows = [(i, [c * scale for c in x] if x else x, label) for i, x, label in cases()[:300]]
        assert mined(spark, rows) == sorted(brute.hard_negatives(rows), key=str)
    index = negatives.ThresholdIndex(np.array([[2**40, 1], [-(2**40), 1]]), np.array([[2**40, 3]]))
    assert [x.tolist() for x in index.reaching(np.array([0]), np.array([1]))] == [[0], [0], [2**63 - 1]]


def test_no_rows_no_anchors_no_positives(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []


@pytest.mark.parametrize("share", [0.9, 0.5, 0.1, -0.2])
def test_index_leaves_out_nothing(share):
    rng = np.random.default_rng(2)
    x, q = (rng.integers(-256, 256, size=(n, 40)) // (1 + np.arange(40)) for n in (500, 30))
    score = q @ x.T
    need = np.full(len(q), int(share * score.max()))
    at, row, total = negatives.ThresholdIndex(x, q).reaching(np.arange(len(q)), need)
    assert sorted(map(list, zip(at.tolist(), row.tolist(), strict=True))) == np.argwhere(score >= need[:, None]).tolist()
    assert (total == score[at, row]).all()


def test_query_on_the_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    con = check.connect(folder)
    assert check.difference(queries.QUERIES["op11_hard_negatives"](spark, folder), con, queries.NEGATIVES_SQL) is None
