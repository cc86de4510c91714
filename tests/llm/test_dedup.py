"""Exact deduplication against SQL, with spill files that must be dealt again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import in_order, prose
from voxtable.llm import grace_dedup, oracles


@pytest.mark.parametrize("bucket, run", [(128 << 20, 32 << 20), (3_000, 9_000)])
def test_groups_are_the_sql(odd, sql, bucket, run):
    assert in_order(grace_dedup.deduplicated(odd, bucket_bytes=bucket, run_bytes=run)) == sql(oracles.OP12)


def test_a_hot_text_is_dealt_by_position(spark, monkeypatch):
    monkeypatch.setattr(grace_dedup, "FEW", 4)
    rng = random.Random(1)
    hot = prose(rng, 40, ["ab", "cd", "ef"])
    rows = [(k, hot if k % 3 else f"other {k}") for k in range(1, 1501)] + [(None, hot), (1499, hot)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(40)
    # runs of one batch each, so that every partition has an entry of the hot text
    got = grace_dedup.deduplicated(docs, bucket_bytes=600, run_bytes=1).collect()
    of_hot = [r for r in got if r.group_size > 1]
    assert len(got) == 1502 and len(of_hot) == 1002 and {(r.keep_id, r.group_size) for r in of_hot} == {(1499, 1002)}
    assert [r.doc_id for r in of_hot if r.kept] == [1499] and sum(r.kept for r in got) == 501


def test_contents_are_compared_whole(spark, monkeypatch):
    """With one hash for all contents the table still tells them apart."""
    table = grace_dedup.ContentTable()
    monkeypatch.setitem(grace_dedup.__dict__, "hash", lambda content: 7)
    numbers = [table.number(f"text {k % 150}".encode()) for k in range(600)]
    assert numbers == [k % 150 for k in range(600)]


def test_kept_rows_have_all_their_columns(odd):
    out = grace_dedup.kept(odd, bucket_bytes=3_000, run_bytes=9_000)
    assert out.columns == odd.columns
    want = odd.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    assert out.count() == want == out.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    assert grace_dedup.kept(odd.limit(0)).count() == 0 and grace_dedup.deduplicated(odd.limit(0)).count() == 0


def test_texts_equal_after_a_change(odd, odd_rows):
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    got = grace_dedup.deduplicated(odd, normal=squeeze).where("doc_id in (23, 24)").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(23, 24, 2, False), (24, 24, 2, True)}
