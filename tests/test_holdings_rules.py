from candlemill.operators import holdings


def test_literals_and_join_find_the_same_news(spark, monkeypatch):
    news = spark.createDataFrame([(1, "Gold up", ["X"], "positive"), (2, "silver down", None, "negative"), (3, "plain", ["GOLD", "SILVER"], "neutral"), (4, "plain", [], "neutral")], "ts long, headline string, tags array<string>, mood string")
    assets = spark.createDataFrame([("GOLD", "gold"), ("SILVER", "silver")], "asset string, pattern string")
    found = lambda: sorted((r.asset, r.ts) for r in holdings.relevant(news, assets).collect())
    one_scan = found()
    monkeypatch.setattr(holdings, "LITERAL_ASSETS", 0)
    assert one_scan == found() == [("GOLD", 1), ("GOLD", 3), ("SILVER", 2), ("SILVER", 3)]
    assert holdings.relevant(news, assets.where("false")).count() == 0


def test_dedupe_prefers_a_cost_and_repairs_ids(spark):
    rows = [(1, 5, "stock", "abc", "Other", 0.0, 1), (1, 6, "Other", "ABC", "Energy", 9.0, 2), (1, 6, "MF", "abc", "-", 0.0, 3), (1, None, "mf", "d", None, None, 4), (2, 6, None, "abc", "Bank", 0.0, 5), (2, 7, "mf", None, "Bank", 1.0, 6)]
    got = holdings.dedupe(spark.createDataFrame(rows, "owner long, id long, type string, name string, sector string, buy double, pos long"), "owner", ["pos"]).orderBy("pos").collect()
    assert [(r.owner, r.id, r.type, r.name, r.sector) for r in got] == [(1, 6, "stock", "ABC", "Energy"), (1, 7, "mf", "abc", None), (1, 8, "mf", "d", None), (2, 6, "stock", "abc", "Bank")]
