"""Decision tables for the verdict rules, audits, sources, sinks and streams."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable import schemas
from voxtable.catalog.tables import arms
from voxtable.functions import columns as fx
from voxtable.plans import audits, experiments, verdicts
from voxtable.sources import readers, writers
from voxtable.streaming import incremental


def scored(spark, gains, scroll="s", base=0.6):
    return spark.createDataFrame([(f"w{i}", scroll, "f", base, base + g if g is not None else None) for i, g in enumerate(gains)], "win string, scroll string, segment string, base double, new double")


@pytest.mark.parametrize(
    "gains,verdict",
    [([0.2] * 19, "UNKNOWN"), ([0.2] * 20, "PASS"), ([0.2] * 14 + [-0.01] * 6, "PASS"), ([0.3] * 13 + [-0.01] * 7, "FAIL"), ([0.04] * 20, "FAIL"), ([0.2] * 14 + [0.0] * 6, "PASS")],
)
def test_paired_gain(spark, gains, verdict):
    assert verdicts.paired_gain_rule(scored(spark, gains), [], "scroll", "base", "new").first().verdict == verdict


def test_paired_gain_scroll_condition(spark):
    rows = scored(spark, [0.3] * 20).unionByName(scored(spark, [-0.01] * 3, "bad"))
    assert verdicts.paired_gain_rule(rows, [], "scroll", "base", "new").first().verdict == "FAIL"
    few = scored(spark, [0.3] * 20).unionByName(scored(spark, [-0.01] * 2, "bad"))
    assert verdicts.paired_gain_rule(few, [], "scroll", "base", "new").first().verdict == "PASS"


@pytest.mark.parametrize("gains,verdict", [([0.1] * 9, "UNKNOWN"), ([0.1] * 7 + [-0.1] * 3, "PASS"), ([0.1] * 6 + [-0.01] * 4, "FAIL"), ([0.0] * 10, "PASS"), ([0.1] * 7 + [-0.3] * 3, "FAIL"), ([0.1] * 9 + [None], "UNKNOWN")])
def test_group_rule(spark, gains, verdict):
    out = {r.scroll: r.verdict for r in verdicts.group_rule(scored(spark, gains, base=0.5), ["scroll"], "new", "base").collect()}
    assert out["s"] == out["ALL"] == verdict


def tuned(spark, n=30, gain=0.03, wins=None, folds=3, bad=0, skipped=0.0, unscored=0):
    wins = n if wins is None else wins
    rows = [(i % folds, 0.7, 0.0 if i < bad else 0.7 + (gain if i < wins else -0.001), 0.72, True, skipped) for i in range(n)]
    rows += [(0, None, None, None, True, skipped)] * unscored
    return spark.createDataFrame(rows, "fold int, base double, new double, third double, planned boolean, skipped double")


@pytest.mark.parametrize(
    "kw,verdict",
    [({}, "PASS"), ({"folds": 2}, "UNKNOWN"), ({"n": 29}, "UNKNOWN"), ({"unscored": 1}, "UNKNOWN"), ({"bad": 1}, "INVALID"), ({"skipped": 0.02}, "INVALID"), ({"wins": 21}, "PASS"), ({"wins": 20, "gain": 0.1}, "FAIL"), ({"gain": 0.01}, "FAIL")],
)
def test_finetune_rule(spark, kw, verdict):
    out = verdicts.finetune_rule(tuned(spark, **kw), [], "base", "new", "third", "fold", "planned", "skipped").first()
    assert out.verdict == verdict


@pytest.mark.parametrize("closed,verdict", [(6, "PASS"), (5, "FAIL")])
def test_gap_closed(spark, closed, verdict):
    rows = [("L", 0.5, 0.8 if i < closed else 0.7, 0.8) for i in range(12)] + [("W", 0.8, 0.81, 0.7)] * 12
    df = spark.createDataFrame(rows, "kind string, zero double, best double, ref double")
    assert verdicts.gap_closed_rule(df, [], "kind", "zero", "best", "ref").first().verdict == verdict
    hole = df.unionByName(spark.createDataFrame([("L", 0.5, None, 0.8)], df.schema))
    assert verdicts.gap_closed_rule(hole, [], "kind", "zero", "best", "ref").first().verdict == "UNKNOWN"


def test_chooser_rule(spark):
    rows = []
    for i in range(12):
        for o in (-8, 0, 8):
            rows.append((f"l{i}", "L", o, 0.6 + (0.2 if o == -8 else 0)))
            rows.append((f"w{i}", "W", o, 0.8))
    s = spark.createDataFrame(rows, "win string, kind string, offset int, auc double")
    pick = s.select("win").distinct()
    good = verdicts.chooser_rule(s, pick.withColumn("chosen", F.lit(-8)), [], "win", "kind", "offset", "auc").first()
    assert good.verdict == "PASS" and np.isclose(good.random_gain_L, 0.2 / 3) and good.oracle_matches == 12
    assert verdicts.chooser_rule(s, pick.withColumn("chosen", F.lit(0)), [], "win", "kind", "offset", "auc").first().verdict == "FAIL"
    assert verdicts.chooser_rule(s, pick.withColumn("chosen", F.lit(5)), [], "win", "kind", "offset", "auc").first().verdict == "UNKNOWN"


@pytest.mark.parametrize("d,outcome", [([0.05] * 6 + [-0.01] * 4, "REAL_INPUT_MATTERS"), ([-0.05] * 6 + [0.01] * 4, "SIM_BETTER"), ([0.2] * 5 + [-0.01] * 5, "NO_CLEAR_DIFFERENCE")])
def test_three_way(spark, d, outcome):
    assert verdicts.three_way_rule(spark.createDataFrame([(x,) for x in d], "d double"), [], "d").first().outcome == outcome


def test_replication_and_null_control(spark):
    a = spark.createDataFrame([("x", "PASS"), ("y", "PASS"), ("z", "PASS"), ("f", "FAIL")], "k string, verdict string")
    b = spark.createDataFrame([("x", "PASS"), ("y", "FAIL"), ("z", "INVALID"), ("f", "FAIL")], "k string, verdict string")
    assert {r.k: r.outcome for r in verdicts.replication(a, b, ["k"]).collect()} == {"x": "REPLICATED", "y": "NOT_REPLICATED", "z": "UNKNOWN", "f": "REPLICATED"}
    c = spark.createDataFrame([(0.55,), (0.65,), (None,)], "auc double").select(verdicts.null_control(F.col("auc"), F.lit("PASS")).alias("v"))
    assert [r.v for r in c.collect()] == ["PASS", "INVALID", "INVALID"]


def test_known_text_gate(spark):
    rows = [(k, 25.0 * abs(k - 5) + 3 if k != 5 else 3.0, 0.0) for k in range(1, 9) if k != 3]
    df = spark.createDataFrame(rows, "w int, med double, share double")
    out = verdicts.known_text_gate(df, "w", "med", "share").collect()
    assert sorted(r.w for r in out if r.chosen) == [2, 4, 5, 6, 7] and {r.gate for r in out} == {"MESH_REACHES"}
    far = df.withColumn("med", F.col("med") + 20)
    assert {r.gate for r in verdicts.known_text_gate(far, "w", "med", "share").collect()} == {"MESH_MISS"}


def test_bucket_flags(spark):
    lv = spark.createDataFrame([("a", 0, 64, 100, 100, 1.0), ("a", 1, 64, 50, 51, 1.0), ("b", 0, 64, 100, 100, 1.0), ("b", 1, 40, 60, 50, 2.0)], "root string, level int, d int, h int, w int, zscale double")
    out = {r.root: r.flags for r in audits.pyramid_levels(lv, ["root"]).collect()}
    assert out == {"a": [], "b": ["META_DEPTH_L1", "META_XY_L1"]}
    fr = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5), ("b", 0, 0.5), ("b", 1, 0.4), ("c", 0, 1.0), ("c", 1, None)], "root string, level int, frac double")
    d = audits.depth_flags(fr, ["root"])
    assert {r.root: r.flags for r in d.collect()} == {"a": ["DEPTH_L1"], "b": [], "c": ["CHUNK_MISSING_L1"]}
    assert {r.flag: r.n for r in audits.flag_counts(d).collect()} == {"DEPTH": 1, "CHUNK_MISSING": 1}
    assert verdicts.bucket_verdict(d, []).first().verdict == "BUCKET_DEFECTS"
    empty = spark.createDataFrame([(["PROBE_EMPTY"],), ([],)], "flags array<string>")
    assert verdicts.bucket_verdict(empty, []).first().verdict == "BUCKET_CLEAN"


def test_seed_scores_and_usable_rows(spark, tmp_path):
    shard = tmp_path / "shard-0"
    shard.mkdir()
    head = "id\tseed_z\tseed_y\tseed_x\tstatus\ttracked\tarea_cm2\tfrac_a\tfrac_b\tp995_a\tp995_b\tstroke_a\tstroke_b\tsecs"
    ok = "{}\t1\t2\t3\tok\t0.9\t1.0\t{}\t{}\t0.5\t0.5\t0.1\t0.0\t9.0"
    (shard / "scores.tsv").write_text("\n".join([head, ok.format(1, "0.2", "0.1"), "2\t1\t2\t3\tno_sheet", ok.format(3, "0.1", "0.1"), ok.format(1, "0.9", "0.8")]) + "\n")
    s = readers.seed_scores(spark, [str(tmp_path / "shard-*")])
    assert {(r.status, r.n) for r in audits.status_counts(s, "status").collect()} == {("ok", 3), ("no_sheet", 1)}
    rows = readers.usable_rows(s, ["shard"], "id", "secs", "frac_a", "frac_b").collect()
    assert [(r.shard, r.id) for r in rows] == [("shard-0", 1)]


def test_transform_json(spark, tmp_path):
    full = {"transformation_matrix": [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]], "moving_landmarks": [[0, 0, 0], [1, 1, 1]], "fixed_landmarks": [[1, 2, 3], [2, 3, 4]], "fixed_volume": "f"}
    (tmp_path / "a.json").write_text(json.dumps(full))
    (tmp_path / "b.json").write_text(json.dumps({**full, "fixed_landmarks": [[1, 2, 3]]}))
    (tmp_path / "c.json").write_text(json.dumps({"transformation_matrix": [[1, 0]], "fixed_volume": "f"}))
    (tmp_path / "d.json").write_text(json.dumps({k: full[k] for k in ("transformation_matrix", "fixed_volume")}))
    t = readers.transforms(spark, str(tmp_path))
    got = {r.key[-6]: r.status for r in t.collect()}
    assert got == {"a": "ok", "b": "landmark count mismatch", "c": "no 3x4 matrix", "d": "no landmarks"}
    assert readers.landmark_rows(t).count() == 2


def test_inventory_and_reports(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS p").write.partitionBy("p").json(str(tmp_path / "t"))
    inv = readers.object_inventory(spark, str(tmp_path / "t"), "*.json")
    assert set(inv.columns) == {"path", "size", "modified"} and inv.count() >= 2
    df = spark.createDataFrame([("a", 0.12345), ("b", None)], "k string, v double")
    writers.write_report(writers.report_columns(df, ["k"], ["v"]), str(tmp_path / "r"), [F.col("k")])
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "r"), "k string, v string").collect()] == [("a", "+0.1235"), ("b", "n/a")]
    assert [r.v for r in df.select(fx.signed4("v").alias("v")).collect()][1] == "n/a"


def test_bits_and_rounding(spark):
    df = spark.createDataFrame([([1, 0, 1, 1, 0, 0, 0, 1, 1, 1],)], "b array<int>")
    packed = df.select(fx.pack_bits("b").alias("p")).first().p
    assert bytes(packed) == np.packbits([1, 0, 1, 1, 0, 0, 0, 1, 1, 1]).tobytes()
    assert df.select(fx.unpack_bits(fx.pack_bits("b")).alias("u")).first().u == np.unpackbits(np.frombuffer(bytes(packed), np.uint8)).tolist()
    r = spark.range(1).select(F.rint(F.lit(2.5)).alias("a"), fx.floor_div(F.lit(-1), 4).alias("b"), fx.stretch_u8(F.lit(0.7499), F.lit(True)).alias("c")).first()
    assert (r.a, r.b, r.c) == (2.0, -1, 254)


def test_plan_comparisons(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0005), ("z", 2.0)], "k string, v double")
    assert {r.k: r.status for r in experiments.plan_tolerance(a, b, ["k"], ["v"]).collect()} == {"x": "SAME", "y": "DIFFERENT", "z": "DIFFERENT"}
    assert experiments.plan_diff(a, a).isEmpty() and experiments.plan_diff(a, b).count() == 4
    v = schemas.violations(a, {"small": F.col("v") < 1.5}, ["k"]).collect()
    assert [(r.k, r.rule) for r in v] == [("y", "small")]


def test_fingerprint_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS g")
    a = experiments.fingerprint(df, ["g"], ["id"]).orderBy("g").collect()
    b = experiments.fingerprint(df.repartition(3, "id"), ["g"], ["id"]).orderBy("g").collect()
    assert a == b and len({r.sha256 for r in a}) == 3
    c = experiments.fingerprint(df.where("id <> 17"), ["g"], ["id"]).orderBy("g").collect()
    assert [x.sha256 == y.sha256 for x, y in zip(a, c)].count(False) == 1


def test_incremental_runs_do_only_new_work(spark, tmp_path):
    feed, sink, mark = (str(tmp_path / n) for n in ("feed", "sink", "mark"))

    def audit(batch):
        return batch.groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    spark.range(100).selectExpr("id", "id % 2 AS g").write.parquet(feed)
    incremental.incremental_audit(spark, feed, "id long, g long", audit, sink, mark)
    incremental.incremental_audit(spark, feed, "id long, g long", audit, sink, mark)
    assert spark.read.parquet(sink).agg(F.sum("n")).first()[0] == 100
    spark.range(100, 130).selectExpr("id", "id % 2 AS g").write.mode("append").parquet(feed)
    incremental.incremental_audit(spark, feed, "id long, g long", audit, sink, mark)
    assert spark.read.parquet(sink).agg(F.sum("n")).first()[0] == 130


def test_leaderboard_keeps_the_best_of_all_batches(spark, tmp_path):
    feed, sink, mark = (str(tmp_path / n) for n in ("feed", "sink", "mark"))
    spark.createDataFrame([(i, float(i % 17)) for i in range(60)], "id long, s double").repartition(4).write.parquet(feed)
    incremental.incremental_leaderboard(spark, feed, "id long, s double", ["id"], "s", 5, sink, mark, files_per_batch=1)
    got = incremental.latest_board(spark, sink).collect()
    assert sorted((-r.s, r.id) for r in got) == sorted((-float(i % 17), i) for i in range(60))[:5]


def test_signed4_rounds_like_c(spark):
    values = [0.79985, 2.76755, 0.03125, 0.09375, 0.00005, -0.00001, -0.0, 9.99995, 9.99999, 0.99995, 1234567.00005, 2.0**52 + 0.5, 1e22, None]
    values += [k / 1e5 for k in range(-40005, 40005, 10)] + [k / 3.2e5 + 7e8 for k in range(4000)]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", fx.signed4("v").alias("t")).collect()
    assert {r.i: r.t for r in out} == {i: "n/a" if v is None else "%+.4f" % v for i, v in enumerate(values)}


def test_exact_means_do_not_depend_on_the_order_of_rows(spark):
    rows = [("a", k, 0.1 * (k % 7) + 1e8 * (k % 2)) for k in range(1000)] + [("b", k, 0.34) for k in range(3)] + [("c", 0, None), ("d", 0, float("nan")), ("e", 0, 1e30), ("e", 1, 2e30)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    up, down = ({r.g: r.m for r in df.repartition(n).sortWithinPartitions(o).groupBy("g").agg(fx.exact_avg("v").alias("m")).collect()} for n, o in ((1, F.col("k")), (7, F.col("k").desc())))
    assert up["a"] == down["a"] == math.fsum(v for g, _, v in rows if g == "a") / 1000
    assert up["b"] == 0.34 and up["c"] is None and math.isnan(up["d"]) and math.isclose(up["e"], 1.5e30)


def test_arms_of_equal_means_are_ties(spark, tmp_path):
    """Two arms with the same quantities in another order, spread over files: no win for either."""
    q = [3, 17, 41, 29, 7, 11, 23, 47, 2, 31, 13, 37]
    for t, rows, schema in (
        ("supplier", [(s, s % 2) for s in range(40)], "s_suppkey long, s_nationkey int"),
        ("nation", [(n, f"n{n}", 0) for n in range(2)], "n_nationkey int, n_name string, n_regionkey int"), ("region", [(0, "r")], "r_regionkey int, r_name string"),
        ("lineitem", [(s, float(v), "R", f"{y}-05-01") for s in range(40) for y, order in ((1995, q), (1997, q[s % 12:] + q[: s % 12][::-1])) for v in order], "l_suppkey long, l_quantity double, l_returnflag string, l_shipdate string"),
    ):
        df = spark.createDataFrame(rows, schema)
        (df.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).repartition(5) if t == "lineitem" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    a = arms(spark, str(tmp_path))
    assert a.where("new <> base").count() == 0 and a.count() == 40
    assert verdicts.three_way_rule(a.selectExpr("scroll", "new - base as d"), ["scroll"], "d").selectExpr("up + down as moved").first().moved == 0


def test_fingerprint_hashes_all_digests_of_a_group_at_once(spark):
    """More blocks than a block has rows: still one digest of the block digests, as the SQL text has it."""
    ids = [str(i) for i in range(50)]
    digests = [hashlib.sha256(";".join(ids[k : k + 4]).encode()).hexdigest() for k in range(0, 50, 4)]
    got = experiments.fingerprint(spark.range(50).selectExpr("id", "'g' AS g"), ["g"], ["id"], block=4).first()
    assert (got.n, got.sha256) == (50, hashlib.sha256(";".join(digests).encode()).hexdigest())
