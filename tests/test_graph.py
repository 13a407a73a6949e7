"""Components and joins on hot keys against plain Python."""

import random

import pytest

from tidewire.operators.graph import components
from tidewire.operators.shuffles import join_unique


def union_find(edges):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for a, b in edges if a != b for n in (a, b)}


def shuffled_chain(first, n, seed):
    ids = random.Random(seed).sample(range(first, first + n), n)
    return list(zip(ids[:-1], ids[1:], strict=True))


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    star = [(5000, 5001 + i) for i in range(1500)]
    giant = [(rng.randrange(10_000, 12_000), rng.randrange(10_000, 12_000)) for _ in range(5000)]
    loose = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(7, 7)]
    edges = [*shuffled_chain(20_000, 1200, 1), *zip(range(30_500, 30_000, -1), range(30_499, 29_999, -1), strict=True), *star, *giant, *loose]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1000, 3])
def test_join_unique_equals_a_join(spark, how, share):
    rows = [(1, i) for i in range(50)] + [(2, i) for i in range(40)] + [(k, k) for k in range(3, 30)] + [(None, 1), (2, 0)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(1, "a", [1]), (3, "b", None), (5, None, [2])], "k long, name string, more array<int>")
    got = join_unique(left, right, "k", how, share=share)
    assert got.columns == ["k", "v", "name", "more"]
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
