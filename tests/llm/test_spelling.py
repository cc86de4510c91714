"""Spelling variants against brute force and SQL."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.conftest import in_order
from voxtable.llm import oracles, spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def groups(words: dict[str, int], ratio: int = 10) -> list[tuple]:
    found = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(found[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= ratio * words[w] else None for w, b in best.items()}
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(found[w]), words.get(form[w])))
    return sorted(out)


def test_the_scan_finds_one_edit():
    rng = random.Random(2)
    for _ in range(1500):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 40))})
        shared = [0, *(len(os.path.commonprefix(p)) for p in zip(words, words[1:]))]
        query = "".join(rng.choice("abé") for _ in range(rng.randint(0, 5)))
        assert [words[k] for k in spelling.one_edit(query, words, shared)] == [w for w in words if near(query, w)]


def test_ranges_with_a_dead_prefix_are_skipped(monkeypatch):
    words = sorted("".join(p) for p in [f"{a}{b}{c}xyz" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"])
    shared = [0, *(len(os.path.commonprefix(p)) for p in zip(words, words[1:]))]
    rows, step = [], spelling.next_row
    monkeypatch.setattr(spelling, "next_row", lambda *a: rows.append(1) or step(*a))
    assert len(list(spelling.one_edit("aaaxyz", words, shared))) == 21
    assert len(rows) < 300  # of 512 words and 3072 letters


@pytest.mark.parametrize("block", [256, 20, 2])
def test_groups_by_brute_force(spark, block):
    rng = random.Random(block)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))): rng.choice([2, 3, 30, 400, 5_000, 60_000]) for _ in range(500)}
    words |= {"a" * n: 10**n for n in range(1, 9)}  # a chain of forms
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n bigint"), block_words=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == groups(words)


def test_a_hot_prefix_is_cut_further(spark):
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choice("abcd") for _ in range(5)) + "end": rng.choice([2, 50]) for _ in range(700)}
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n bigint"), block_words=16)
    assert sorted(map(tuple, got.collect())) == groups(words)


def test_variants_are_the_sql(odd, odd_rows, sql):
    assert in_order(spelling.spelling_variants(odd)) == sql(oracles.OP11)
    counts: Counter = Counter()
    for doc_id, text, *_ in odd_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[word] += len(word) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    assert len(words) > 50 and sorted(map(tuple, spelling.spelling_variants(odd).collect())) == groups(words)


def test_empty_tables(odd, spark):
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    assert spelling.variant_groups(spark.createDataFrame([("lonely", 3)], "word string, n bigint")).collect()[0].root == "lonely"
