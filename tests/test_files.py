"""Readers and sinks on real files, and plan shapes."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import cutlake
from cutlake.operators.scan import position, prev, scan
from cutlake.sources import catalog as C
from cutlake.sources import receipts as R
from cutlake.sources import sinks as K

SF = "/root/testdata/sf0.001"


def test_catalog_names_the_bad_line(spark, tmp_path):
    path = tmp_path / "cat.jsonl"
    path.write_text('{"path": "a", "top_visual_labels": ["x", {"label": "y"}]}\n\n{"path": "b"}\n')
    rows = {r.path: r.labels for r in C.read_catalog(spark, str(path)).collect()}
    assert rows == {"a": ["x", "y"], "b": []}
    path.write_text('{"path": "a"}\n[1, 2]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        C.read_catalog(spark, str(path)).collect()


def test_features_ledger_library(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"path": "p", "luma_p50": 1}, {"path": "p", "luma_p50": 2}, {"x": 1}]}))
    assert [(r.path, r.luma_p50) for r in C.read_feature_table(spark, str(tmp_path / "f.json")).collect()] == [("p", 2.0)]
    (tmp_path / "g.jsonl").write_text('{"stem": "a", "grade": "HERO"}\n{"stem": "b", "gr\n{"grade": "x"}\n')
    assert [r.stem for r in C.read_ledger(spark, str(tmp_path / "g.jsonl")).collect()] == ["a"]
    (tmp_path / "lib.json").write_text(json.dumps({"clips": {"c1": {"name": "n", "tags": {"world_cluster": "gym"}}, "c2": {"name": "m"}}}))
    assert {r.clip_id: r.world for r in C.read_library(spark, str(tmp_path / "lib.json")).collect()} == {"c1": "gym", "c2": "UNTAGGED"}


def test_receipt_status_only_under_a_head(spark, tmp_path):
    text = 'Disposition: REJECT\nACK — lane-1 — 2026-01-02T03:04:05Z — picked up: go\n<!--status {"state":"running"} -->\nnote\n<!--status {"state":"finished"} -->\n'
    (tmp_path / "ui-feedback-row07-20260102T030000Z.md").write_text(text)
    receipts = R.read_receipts(spark, str(tmp_path / "*.md"))
    r = receipts.first()
    assert (r.kind, r.row, r.disposition, r.author) == ("feedback", 7, "REJECT", "operator")
    assert [(h.lane, h.state) for h in r.heads] == [("lane-1", "running")]
    assert R.status_blocks(receipts).first().state == "running"


def test_status_sink_quarantines(spark, tmp_path):
    rows = [(1, "running", "x", None), (2, "queued", "x", None), (3, "called", "which? 1 = a, 2 = b", None), (4, "called", "which?", None)]
    lines = spark.createDataFrame(rows, "id int, state string, text string, why string")
    K.append_status(lines, str(tmp_path / "ok"), str(tmp_path / "bad"))
    K.append_status(lines, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 4
    assert {(r.id, r.fault) for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {(2, "why_required"), (4, "call_without_options")}


def test_event_sink_refuses_a_bad_kind(spark, tmp_path):
    events = spark.createDataFrame([(1, "stage_done", "p"), (2, "Bad Kind", "q")], "id int, kind string, project string")
    K.append_events(events.where("id = 1"), ["project"], str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).first().payload == '{"project":"p"}'
    with pytest.raises(Exception, match="must be a token"):
        K.append_events(events, ["project"], str(tmp_path / "e"))


def test_snapshot_partitions_accumulate(spark, tmp_path):
    df = spark.range(2)
    K.write_snapshot(df, str(tmp_path / "s"), "one")
    K.write_snapshot(df, str(tmp_path / "s"), "two")
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("snapshot").count().count() == 2


def test_sql_names(spark):
    cutlake.register(spark)
    r = spark.sql("SELECT cl_michelson(3, 1) AS m, cl_hue_delta(350, 10) AS h, size(cl_segments(12.5)) AS n, cl_normalize_text('Ａ b') AS t").first()
    assert (r.m, r.h, r.n, r.t) == (0.5, 20.0, 2, "ab")
    assert spark.sql("SELECT * FROM cl_blocks_from_cuts(10, array(4L, 4L))").count() == 2


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


HOT = ["w1_dedupe_within", "g21_phase_stats", "j5_window_grade", "j8_nearest", "j9_frame_compare", "a1_shortlist", "g4_reuse_map", "w11_detect_cuts", "l4_layer_status", "g11_frame_distance_pairs"]


@pytest.mark.parametrize("name", HOT)
def test_no_cross_join_in_plan(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["j4_terminally_failed"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in text
    assert "text:string" not in plan(entry.queries()["g30_separation_margin"](spark, SF))


def test_scan_shuffles_its_rows_once(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.col("id").alias("v"))
    text = plan(scan(df, ["k"], ["pos"], 10, p=prev("v"), i=position()))
    assert "Python" not in text and text.count("hashpartitioning(_key") <= 4
