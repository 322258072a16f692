"""Tables that are sorted or numbered whole are dealt to tasks by their rows."""

import re

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_rows(spark, monkeypatch, capsys):
    from spinlattice.catalog_queries import QUERIES
    from spinlattice.plans import views

    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    wanted = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    for name in ("a12_export_manifest", "f01_transitions", "f02_setlist_flow", "c29_trajectory", "f08_key_journey"):
        QUERIES[name](spark, SF).explain()
        dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)
        assert {by for by, n in dealt if int(n) == wanted} >= {"l_orderkey", "track_id"} and wanted > 4, (name, dealt)


def test_opinions_are_sorted_once_in_tasks_by_rows(spark, monkeypatch, capsys):
    from spinlattice.plans import views

    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    wanted = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    views.view(spark, SF, "v_opinions").explain()
    plan = capsys.readouterr().out
    assert re.search(rf"hashpartitioning\(l_partkey#\d+L?, {wanted}\), REPARTITION_BY_NUM", plan)
    assert "Partial" not in plan and plan.count("Sort [l_partkey") == 1  # nothing is sorted before it is dealt


def test_transitions_look_codes_up(spark):
    from spinlattice.functions import keys
    from spinlattice.operators import harmony

    codes = ["8A", "9A", "8B", None, "x", "08a", "12B", "3A", "10A", "6A", "1B", ""]
    rows = [(1, i, i, k, b) for i, (k, b) in enumerate(zip([x for a in codes for b in codes for x in (a, b)], [120.0, 131.0, None, 0.0, 90.0] * 58, strict=False))]
    got = harmony.transitions(spark.createDataFrame(rows, "playlist_id long, position long, track_id long, key_camelot string, bpm double"))
    pairs = [(*a, *b[2:]) for a, b in zip(rows, rows[1:], strict=False)]
    from pyspark.sql import functions as F

    rel, d = keys.relation(F.col("k"), F.col("l")), keys.delta_percent(F.col("b"), F.col("d"))
    plain = spark.createDataFrame(pairs, "p long, at long, t long, k string, b double, u long, l string, d double").select("p", "at", "t", "u", rel, d, keys.transition_score(rel, d), keys.relation_label(rel), keys.relation_risk(rel), keys.delta_text(d))
    order = got.select("playlist_id", "position", "track_id", "next_id", "relation", "delta_pct", "score", "label", "risk", "delta_text")
    assert sorted(map(tuple, order.collect())) == sorted(map(tuple, plain.collect())) and len(pairs) == got.count()
