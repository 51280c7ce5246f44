import random

from tessera.llm.graph import components, of_one_id


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        top[max(p, q)] = min(p, q)
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_and_equal_ends(spark):
    got = components(spark.createDataFrame([(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (None, None)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(4, 4), (5, 4)]


def test_rows_of_one_id(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 7), (2, 9), (3, None), (4, 3), (4, None), (None, 8), (None, 5)], "id long, rep long")
    got = {r["node"]: r["label"] for r in components(of_one_id(rows)).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 9: 1, 3: 3, 4: 3}
