"""Connected components by both ways."""


def test_few_and_many_edges_give_the_same_components(spark, monkeypatch):
    """Few edges take no round of jobs; a chain, a star, a ring and repeated edges."""
    from framesift.llm import components

    edges = [(i, i + 1) for i in range(-50, 0)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 301), (301, 300), (9, 9)]
    df = spark.createDataFrame(edges, "u long, v long")
    few = sorted(map(tuple, components.connected_components(df, max_rounds=0).collect()))
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert few == sorted(map(tuple, components.connected_components(df).collect()))
    assert dict(few)[0] == -50 and dict(few)[120] == 100 and 9 not in dict(few)
    assert components.connected_components(df.limit(0)).count() == 0
