"""Spelling variants: words one edit apart by dynamic programming over sorted lists, whose edit-matrix rows are shared by common prefixes.

Two words one edit apart agree before the edit and after it. So the places of a word are halved: words meet that agree outside one half, and where
too many do, the half is halved again. What meets is a sorted block, small however common its letters are.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import all_bytes
from voxtable.session import stored

#: Distances are only told up to one edit; this stands for all more.
FAR = 2
Row = tuple[int, int, int]


def _counted(least_length: int, share: int, most: int):
    """word, n: occurrences in a run of texts, added up within a task as far as ``most`` words go."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), all_bytes(batch.column(1))):
                # bytes.lower() leaves all but A-Z alone
                found = Counter(m[0] for m in runs.finditer(text.lower().decode("utf-8", "replace")))
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), head)
                    if h % share == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
            if len(total) > most:
                yield flushed(total)
                total = Counter()
        if total:
            yield flushed(total)

    return count


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, share: int = 31, most: int = 200_000) -> DataFrame:
    """word, n of the words of all texts. Where ``share`` divides the crc32 of "doc_id:word", a letter of the word is lost in that document.

    Null texts have no words; a null id is written as nothing. ``most`` bounds the words a task holds before it passes them on.
    """
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(_counted(least_length, share, most), "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def next_row(row: Row, query: str, i: int, letter: str) -> Row:
    """Row i of the edit matrix (i letters of a listed word, the last being ``letter``) from row i - 1; cells i-1, i, i+1 of the query."""
    a, b, c = row
    n = len(query)
    left = FAR if i < 1 or i - 1 > n else min(a + (i < 2 or query[i - 2] != letter), b + 1)
    mid = FAR if i > n else min(b + (query[i - 1] != letter), c + 1, left + 1)
    right = FAR if i >= n else min(c + (query[i] != letter), mid + 1)
    return left, mid, right


def one_edit(query: str, words: list[str], shared: list[int]) -> Iterator[int]:
    """Positions of the words one edit from the query. ``words`` is sorted; ``shared[k]`` counts the letters that words k-1 and k begin with.

    Rows of the matrix are kept as far as the next word shares its prefix. If a row has no cell within one edit, no word with that prefix
    is near, and the whole range goes.
    """
    n, size, k = len(query), len(words), 0
    rows: list[Row] = [(FAR, 0, 1 if n else FAR)]
    while k < size:
        word = words[k]
        i = len(rows) - 1
        row = rows[i]
        length = len(word)
        while i < length:
            letter = word[i]
            i += 1
            row = next_row(row, query, i, letter)
            if row[0] > 1 and row[1] > 1 and row[2] > 1:
                break
            rows.append(row)
        else:
            if -2 < n - length < 2 and row[1 + n - length] == 1:
                yield k
            k += 1
            if k < size:
                del rows[shared[k] + 1 :]
            continue
        dead = word[:i]
        k = k + 1 if k + 1 == size or shared[k + 1] < i else bisect_left(words, dead + "\U0010ffff", k + 1)
        if k < size:
            # the next word shares less than the dead prefix with this one
            del rows[len(os.path.commonprefix((dead, words[k]))) + 1 :]


def _halves(m, lo, hi):
    """Columns of the two windows that a window is cut into."""
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), lo.alias("lo"), mid.alias("hi")), F.struct(m.alias("m"), mid.alias("lo"), hi.alias("hi")))


def _placed(words: DataFrame) -> DataFrame:
    """word, n, m, lo, hi, key: what a pair of a word of m letters and another of m or m+1 agrees on if their edit lies at places lo to hi."""
    w = F.col("w")
    here = words.select("word", "n", F.explode("windows").alias("w")).select("word", "n", "w.m", "w.lo", "w.hi")
    tail = F.col("m") - F.col("hi")
    head, rest = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.char_length("word") - tail + 1, tail)
    return here.withColumn("key", F.concat_ws(" ", "m", "lo", "hi", head, rest))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best_n, best of each word in the blocks, which come whole and sorted."""
    key, block, out = None, [], []

    def done() -> list[tuple]:
        return _near(block) if len(block) > 1 else []

    def told(rows: list[tuple]) -> pa.RecordBatch:
        types = (("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()))
        return pa.RecordBatch.from_pydict({name: pa.array([r[j] for r in rows], kind) for j, (name, kind) in enumerate(types)})

    for batch in batches:
        for here, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "lo", "hi"))):
            if here != key:
                out += done()
                key, block = here, []
            block.append(row)
        if len(out) > 50_000:
            yield told(out)
            out = []
    out += done()
    if out:
        yield told(out)


def _near(block: list[list]) -> list[tuple]:
    """(word, n_near, best_n, best) within a sorted block of (word, n, m, lo, hi); a pair counts only in the window that holds its first difference."""
    _, _, m, lo, hi = block[0]
    parts = [row[0][lo : len(row[0]) - (m - hi)] for row in block]
    if len(parts[0]) == len(parts[-1]) and all(len(p) > hi - lo for p in parts):
        return []  # longer words only: they meet as the shorter ones elsewhere
    shared = [0, *(len(os.path.commonprefix((a, b))) for a, b in zip(parts, parts[1:]))]
    best: dict[int, list] = {}

    def met(k: int, other: int) -> None:
        word, n = block[other][0], block[other][1]
        have = best.get(k)
        if have is None:
            best[k] = [1, n, word]
            return
        have[0] += 1
        if n > have[1] or (n == have[1] and word < have[2]):
            have[1], have[2] = n, word

    for k, part in enumerate(parts):
        if len(part) == hi - lo:
            for other in one_edit(part, parts, shared):
                y = parts[other]
                if hi == m or y[: hi - lo] != part:
                    met(k, other)
                    if len(y) > len(part):
                        met(other, k)
    return [(block[k][0], *v) for k, v in best.items()]


def near_words(words: DataFrame, block_words: int = 256) -> DataFrame:
    """word, n_near, best_n, best: of each word with near words (one letter put in, lost or replaced) how many, and the most frequent one (ties: the
    first in code-point order). ``words`` has word (distinct) and n.

    A word of L letters is searched for among those of L and L + 1, so that it lies in blocks of two lengths. A block of more than ``block_words``
    words is cut by halving its window of places, down to one place, where only the alphabet bounds it.
    """
    length = F.char_length("word")
    whole = lambda m: _halves(m, F.lit(0), m)
    level = _placed(words.select("word", "n", F.concat(whole(length), F.filter(whole(length - 1), lambda w: w["m"] > 0)).alias("windows")))
    settled = None
    while True:
        crowded = level.groupBy("key", "lo", "hi").agg(F.count("*").alias("rows")).where((F.col("rows") > block_words) & (F.col("hi") - F.col("lo") > 1)).select("key")
        crowded = stored(crowded, "crowded")
        more = not crowded.isEmpty()
        fits = level.join(crowded, "key", "left_anti") if more else level
        settled = fits if settled is None else settled.unionByName(fits)
        if not more:
            break
        level = stored(_placed(level.join(crowded, "key", "left_semi").select("word", "n", _halves(F.col("m"), F.col("lo"), F.col("hi")).alias("windows"))), "windows")
    blocks = settled.repartition("key").sortWithinPartitions("key", "word").select("key", "word", "n", "m", "lo", "hi")
    each = blocks.mapInArrow(_scanned, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"), F.col("best_n").alias("n"))).alias("first")
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.n").alias("best_n"), F.col("first.word").alias("best"))


def variant_groups(words: DataFrame, ratio: int = 10, block_words: int = 256) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of (word, n).

    ``form`` is the most frequent near word if it is ``ratio`` times as frequent at least, else null; ``root`` is where the forms lead, the word itself
    if it has none. An empty table gives no rows.
    """
    words = stored(words, "words")
    near = near_words(words, block_words)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    out = stored(out, "forms")
    # each step multiplies n by the ratio, so the largest n bounds the steps; a round of joins doubles those taken
    most = out.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, int(math.log(most, max(ratio, 2))) + 1)
    led = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if ratio > 1 else 0):
        further = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = stored(led.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, share: int = 31, ratio: int = 10, block_words: int = 256) -> DataFrame:
    """``variant_groups`` of the ``vocabulary`` of the texts. Runs of the letters A-Z, a-z and U+00C0 to U+00FF are words, A-Z in lower case.

    Null and empty texts add nothing, very long texts are read whole, rows alike count each, other columns are not read.
    """
    return variant_groups(vocabulary(docs, doc_id, text, least_length, least_count, share), ratio, block_words)
