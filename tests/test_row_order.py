"""Sums of doubles in the order of rows: queries whose ties a rounding decides equal their SQL text on one thread, whatever the files."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_catalog import plain
from voxtable.catalog.tables import in_rows

TABLES = "region nation supplier lineitem orders events".split()
FILES = 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Few rows a group, so that equal means abound; each table in files of several row groups, the later names written first."""
    path, g, n = tmp_path_factory.mktemp("rows"), np.random.default_rng(6), 24000
    flag, discount = g.choice(list("ANR"), n), g.integers(0, 11, n)
    # the last 200 suppliers have returned lines of 42 and new ones of 40 hundredths, a ratio of 1.05
    tens = [t for t in g.integers(0, 11, (20000, 10)) if t.sum() in (42, 40)]
    pairs = list(zip([t for t in tens if t.sum() == 42][:200], [t for t in tens if t.sum() == 40][:200]))
    flag, discount = np.append(flag, ["R"] * 2000 + ["N"] * 2000), np.concatenate([discount, *[p[0] for p in pairs], *[p[1] for p in pairs]])
    supplier = np.concatenate([g.integers(0, 800, n), np.tile(np.repeat(np.arange(800, 1000), 10), 2)])
    m = len(supplier)
    tables = {
        "region": {"r_regionkey": range(5), "r_name": list("abcde")},
        "nation": {"n_nationkey": range(25), "n_name": [f"n{k}" for k in range(25)], "n_regionkey": [k % 5 for k in range(25)]},
        "supplier": {"s_suppkey": range(1000), "s_nationkey": [k % 25 for k in range(1000)]},
        "lineitem": {
            "l_suppkey": supplier, "l_quantity": g.integers(23, 28, m) / 1.0, "l_discount": discount / 100, "l_returnflag": flag,
            "l_linestatus": g.choice(list("FO"), m), "l_shipdate": np.datetime64("1995-01-02", "us") + g.integers(0, 2499, m) * np.timedelta64(1, "D"),
        },
        "orders": {"o_custkey": g.integers(0, 900, n), "o_totalprice": g.integers(0, 60, n) / 10 + 1000.01},
        "events": {"user_id": g.integers(0, 6000, n), "event_type": g.choice(["view", "purchase"], n), "value": g.integers(1, 800, n) * 0.05},
    }
    for name, columns in tables.items():
        rows = pd.DataFrame({c: np.asarray(v) for c, v in columns.items()})
        (path / f"{name}.parquet").mkdir()
        for k in reversed(range(FILES)):
            rows.iloc[len(rows) * k // FILES : len(rows) * (k + 1) // FILES].to_parquet(path / f"{name}.parquet" / f"part-{k}.parquet", row_group_size=1000, index=False)
    return str(path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in rel.description]
    theirs = sorted(repr(tuple(plain(v) for v in row)) for row in rel.fetchall())
    mine = sorted(repr(tuple(plain(row[c]) for c in heads)) for row in entry.queries()[name](spark, folder).collect())
    assert mine and mine == theirs


def test_sums_follow_the_rows(spark, folder):
    rows = pd.concat([pd.read_parquet(f"{folder}/orders.parquet/part-{k}.parquet") for k in range(FILES)])
    want: dict = {}
    for key, value in zip(rows.o_custkey, rows.o_totalprice):
        want[key] = want.get(key, 0.0) + value
    got = {r.o_custkey: r.s for r in in_rows(spark, folder, "orders", ["o_custkey"], "o_totalprice").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).collect()}
    assert got == want


@pytest.mark.parametrize("name", "dose_response finetune_rule one_sided paired_gain plan_tolerance report_format report_sink three_way group_rule mesh_verdict gap_closed".split())
def test_query_equals_its_sql_on_one_thread(spark, folder, name):
    same_as_sql(spark, folder, name)
