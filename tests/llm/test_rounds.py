"""Component rounds run as small plans: what the driver holds does not grow with keys that are not hot."""

import random

from pyspark.sql import functions as F


def test_join_without_hot_keys_is_one_join(spark, capsys, monkeypatch):
    from spinlattice.llm import common

    rows = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    plain = common.join_hot(rows, facts, "k", "n", F.col("id"))
    plain.explain()
    assert "Union" not in capsys.readouterr().out
    monkeypatch.setattr(common, "HOT", 10)
    split = common.join_hot(rows, facts, "k", "n", F.col("id"))
    assert sorted(map(tuple, plain.select("k", "id", "n").collect())) == sorted(map(tuple, split.select("k", "id", "n").collect()))


def test_components_with_and_without_hubs(spark, monkeypatch):
    from spinlattice.llm import common
    from spinlattice.llm.components import components

    rng = random.Random(3)
    pairs = [(0, k) for k in range(1, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 440)]
    least = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    wanted = {x: m for x, m in least.items() if any(x in p and p[0] != p[1] for p in pairs)}
    for hot in (10_000, 20):
        monkeypatch.setattr(common, "HOT", hot)
        assert {r["node"]: r["component"] for r in components(edges).collect()} == wanted
