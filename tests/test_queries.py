"""Every registered query against its SQL, on the smallest tables."""

import math
import random
from collections import Counter

import pytest

from gridloom.operators import similarity
from gridloom.plans.oracles import SQL
from gridloom.plans.queries import QUERIES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in SQL:
        relation = duck.sql(SQL[name])
        names = list(relation.columns)
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())
        assert got == want


def test_lsh_recall(spark, sf_dir):
    key = ["cell_id", "nbr_id"]
    exact = {tuple(r) for r in QUERIES["similar_cells"](spark, sf_dir).select(*key).collect()}
    rough = {tuple(r) for r in QUERIES["similar_lsh"](spark, sf_dir).select(*key).collect()}
    assert len(exact & rough) >= 0.9 * len(exact)


def test_lsh_on_skewed_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(13)]) for i in range(600)] + [(1000 + i, [rng.gauss(0, 30) for _ in range(13)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "cell_id long, z array<double>")
    key = ["cell_id", "rank", "nbr_id"]
    exact = {tuple(r) for r in similarity.exact_knn(vectors, "cell_id").select(*key).collect()}
    # hot buckets of 600 rows, in blocks of 100
    for rows_per_block in (100, 4096):
        rough = {tuple(r) for r in similarity.approximate_knn(vectors, "cell_id", rows_per_block=rows_per_block).select(*key).collect()}
        assert Counter(c for c, _, _ in rough) == {i: 5 for i, _ in rows}
        assert len(exact & rough) >= 0.9 * len(exact)
        assert {r for r in rough if r[0] >= 1000} == {r for r in exact if r[0] >= 1000}
    few = vectors.where("cell_id < 4")
    assert similarity.approximate_knn(few, "cell_id").count() == 12
    assert similarity.approximate_knn(few.where("false"), "cell_id").count() == 0
