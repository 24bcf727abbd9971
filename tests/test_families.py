"""Stars of families against taking rows in turn."""

import random

import pytest

from tendril.operators import families


def in_turn(pairs, ranks):
    edges = {}
    for a, b in pairs:
        if a != b and a in ranks and b in ranks:
            edges.setdefault(a, set()).add(b)
            edges.setdefault(b, set()).add(a)
    order = lambda n: (ranks[n] is None, ranks[n] or 0, n)
    of, heads = {}, set()
    for n in sorted(edges, key=order):
        free = [m for m in edges[n] if m not in of and m not in heads]
        if n not in of and n not in heads and free:
            heads.add(n)
            of |= {m: n for m in free}
    return of


@pytest.mark.parametrize("seed", [1, 2])
def test_stars(spark, seed):
    r = random.Random(seed)
    ranks = {n: r.choice([None, *range(5)]) for n in range(80)}
    pairs = [(r.randint(0, 85), r.randint(0, 85)) for _ in range(110)] + [(7, x) for x in range(20, 40)] + [(3, 3)]
    df = spark.createDataFrame([*pairs, (None, 4), *pairs[:5]], "a long, b long")
    nodes = spark.createDataFrame([(n, k, "x") for n, k in ranks.items()] + [(None, 1, "x")], "n long, rank int, a string")
    got = {(x.member, x.head) for x in families.stars(df, "a", "b", nodes, "n", "rank").collect()}
    assert got == set(in_turn(pairs, ranks).items())


def test_no_pairs(spark):
    nodes = spark.createDataFrame([(1, 1)], "n long, rank int")
    assert families.stars(spark.createDataFrame([], "a long, b long"), "a", "b", nodes, "n", "rank").count() == 0
