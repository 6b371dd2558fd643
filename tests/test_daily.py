"""The daily run end to end over the small test tables."""

from helpers import rows
from ludoscope.fixtures import adapters as fx
from ludoscope.operators import quality
from ludoscope.plans import daily, graph
from ludoscope.sources.topics import TOPICS
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_daily_run(spark, tmp_path):
    loaded = daily.Loaded(
        catalog_a=fx.catalog_a(spark, SMALL),
        catalog_b=fx.catalog_b(spark, SMALL),
        events={t: fx.topic(spark, SMALL, t) for t in TOPICS},
        windows={t: fx.windows(spark, SMALL, t) for t in TOPICS},
    )
    views = daily.staging_views(loaded, purchases={"viral_from": 2}, sessions={"spike_from": 2})
    assert len(views) == 10
    marts = daily.mart_tables(views, str(tmp_path / "marts"), as_of=fx.AS_OF)
    assert set(marts) == {k for k in quality.KEYS if k.startswith("mart_")}
    assert spark.sql("select count(*) from mart_games").first()[0] == 200
    first = daily.graph_tables(marts, str(tmp_path / "graph1"))
    stats = graph.graph_stats(*(first[n] for n in ("nodes_game", "nodes_genre", "nodes_publisher", "nodes_other", "edges", "similar")))
    assert {r.name for r in stats.collect()} >= {"Game", "Genre", "Publisher", "Tag", "SIMILAR_TO", "BELONGS_TO"}

    # A second load without a wipe keeps edges that the new scores no longer support.
    scores = F.when(F.col("steam_app_id") % 2 == 0, F.lit(10.0)).otherwise(F.lit(90.0))
    changed = {**marts, "mart_games": marts["mart_games"].withColumn("popularity_score", scores)}
    second = daily.graph_tables(changed, str(tmp_path / "graph2"), kept=first)
    assert second["similar"].count() > daily.graph_tables(changed, str(tmp_path / "graph3"))["similar"].count()
    assert second["nodes_game"].count() == first["nodes_game"].count() == 200
    found = daily.findings_table(second, str(tmp_path / "kg"), fx.AS_OF)
    assert found.filter("anomaly_type = 'sales_inconsistency'").count() > 50
    total = found.count()
    assert daily.findings_table(second, str(tmp_path / "kg"), fx.AS_OF).count() == total

    report = daily.check_tables(loaded, marts)
    failing = [r for r in rows(report) if r[3]]
    assert failing == [] and report.count() == 19


def test_merged_replaces_by_key(spark):
    kept = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5)], "a int, b int, s double")
    fresh = spark.createDataFrame([(1, 2, 0.9), (4, 5, 0.9)], "a int, b int, s double")
    assert rows(graph.merged(kept, fresh, "a", "b")) == [(1, 2, 0.9), (1, 3, 0.5), (4, 5, 0.9)]
