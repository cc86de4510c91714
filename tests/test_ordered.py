"""Order statistics: the split path must give what a plain window gives, for hot groups and ties alike."""

import numpy as np
import pandas as pd
import pytest

from voxtable.operators import auc, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(4000) < 0.6, 0, rng.integers(1, 9, 4000))
    v = np.where(rng.random(4000) < 0.33, 7.0, rng.integers(0, 500, 4000) / 4)
    return pd.DataFrame({"id": np.arange(4000), "g": g, "v": v})


@pytest.mark.parametrize("ranges", [None, 7])
def test_running_totals(spark, skewed, ranges):
    df = spark.createDataFrame(skewed)
    got = ordered.running_totals(df, ["g"], ["v", "id"], ["v"], ranges=ranges).toPandas().sort_values(["g", "v", "id"])
    want = skewed.sort_values(["g", "v", "id"])
    before = want.groupby("g")["v"].cumsum() - want["v"]
    assert np.allclose(got["v_before"].to_numpy(), before.to_numpy())
    assert np.allclose(got["v_total"].to_numpy(), want.groupby("g")["v"].transform("sum").to_numpy())


@pytest.mark.parametrize("ranges", [None, 5])
def test_numbered_without_group(spark, skewed, ranges):
    got = ordered.numbered(spark.createDataFrame(skewed), [], ["v", "id"], ranges=ranges).toPandas().sort_values("rn")
    want = skewed.sort_values(["v", "id"])
    assert got["rn"].tolist() == list(range(1, 4001))
    assert got["id"].tolist() == want["id"].tolist()


@pytest.mark.parametrize("ranges", [None, 6])
def test_percentiles(spark, skewed, ranges):
    got = ordered.percentiles(spark.createDataFrame(skewed), ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.995}, ranges).toPandas().set_index("g").sort_index()
    want = skewed.groupby("g")["v"].quantile([0.1, 0.5, 0.995]).unstack()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_percentiles_of_two_columns(spark, skewed):
    df = spark.createDataFrame(skewed.assign(w=skewed["v"] * -2))
    wanted = {"v": {"v5": 0.5}, "w": {"w1": 0.1}}
    a = ordered.percentiles_of(df, ["g"], wanted).toPandas().set_index("g").sort_index()
    b = ordered.percentiles_of(df, ["g"], wanted, ranges=4).toPandas().set_index("g").sort_index()
    assert np.allclose(a[["v5", "w1"]], b[["v5", "w1"]])


@pytest.mark.parametrize("ranges", [None, 9])
def test_neighbours(spark, skewed, ranges):
    got = ordered.neighbours_in_order(spark.createDataFrame(skewed), ["g"], ["v", "id"], ["id"], ranges).toPandas().sort_values(["g", "v", "id"])
    want = skewed.sort_values(["g", "v", "id"]).groupby("g")["id"]
    assert got["prev_id"].fillna(-1).tolist() == want.shift(1).fillna(-1).tolist()
    assert got["next_id"].fillna(-1).tolist() == want.shift(-1).fillna(-1).tolist()


def test_top_share_mean(spark, skewed):
    got = ordered.top_share_mean(spark.createDataFrame(skewed), ["g"], "v", 0.05).toPandas().set_index("g")["top_mean"]
    for g, v in skewed.groupby("g")["v"]:
        k = max(1, int(np.ceil(0.05 * len(v))))
        assert np.isclose(got[g], np.sort(v)[-k:].mean())


def test_auc_tie_rules(spark):
    rows = [(s, p) for s, p in zip([1, 2, 2, 3, 3, 3, 4], [0, 1, 0, 1, 0, 0, 1])]
    df = spark.createDataFrame([(float(s), bool(p)) for s, p in rows], "s double, p boolean")
    counts = auc.score_counts(df, [], "s", "p")
    mid = auc.rank_auc(counts, [], "s", "mid", 1).first()["auc"]
    against = auc.rank_auc(counts, [], "s", "against", 1).first()["auc"]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    wins = sum(a > b for a in pos for b in neg)
    ties = sum(a == b for a in pos for b in neg)
    assert np.isclose(mid, (wins + ties / 2) / 12) and np.isclose(against, wins / 12)
    assert auc.rank_auc(counts, [], "s", "mid", 5).first()["auc"] is None


@pytest.mark.parametrize("ranges", [None, 6])
def test_null_keys_and_groups_of_nulls(spark, ranges):
    rows = [(None if k % 4 == 0 else k % 4, k % 7, k, float(k % 11) if k % 4 != 3 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, h int, id int, v double")
    assert ordered.numbered(df, ["g"], ["h", "id"], ranges=ranges).where("rn_of = 100").count() == 400
    got = {r.g: r.m for r in ordered.percentiles(df, ["g"], "v", {"m": 0.5}, ranges).collect()}
    assert set(got) == {None, 1, 2, 3} and got[3] is None and got[None] == float(np.median([k % 11 for k in range(0, 400, 4)]))
    near = ordered.neighbours_in_order(df, ["g"], ["h", "id"], ["id"], ranges)
    assert near.count() == 400 and near.where("prev_id is null").count() == 4
    assert ordered.carry_forward(df, ["g"], ["h", "id"], "v", "last", ranges).where("last is null").count() == 100


def test_medians_of_nested_windows_need_no_exchange(spark):
    """The windows of a pair lie in one row: their medians are worked out there."""
    from voxtable.plans import audits

    shifts = {"a": [[1.0, 2.0, 30.0], None, [4.0, 8.0, 6.0]], "b": [[5.0, 3.0, 4.0]], "c": [None]}
    win = "struct<window_um:array<long>,grid_um:double,ncc0:double,best:double,shift_um:array<double>>"
    pairs = {o: (4.8, len(w), 0.1, 0.2, [([1], 4.8, 0.1, 0.2, s) for s in w]) for o, w in shifts.items()}
    audit = spark.createDataFrame([("s/1", "r-1", pairs)], f"segment string, reference string, pairs map<string,struct<grid_um:double,n:int,median_ncc0:double,median_best:double,windows:array<{win}>>>")
    out = audits.placement_report(audit)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.scan, r.dz, round(r.inplane, 9)) for r in out.collect()) == [("a", 2.5, round((25 + 18**2) ** 0.5, 9)), ("b", 5.0, 5.0)]


def test_percentiles_keep_groups_without_values(spark):
    rows = [("a", float(v)) for v in range(1000)] + [("b", None)] * 3 + [("c", 7.0), ("c", None)]
    got = ordered.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "t": 0.901}, ranges=16)
    assert {r.g: (r.m, r.t) for r in got.collect()} == {"a": (499.5, pytest.approx(900.099)), "b": (None, None), "c": (7.0, 7.0)}
