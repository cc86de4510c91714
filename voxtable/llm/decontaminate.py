"""Benchmark decontamination: Wu-Manber search for the word windows of test items in whole texts."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import all_bytes, slices

#: Bytes to word form: A-Z lower-cased; digits, letters and all bytes beyond ASCII kept; the rest separates.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows(items: list[tuple[str, bytes]], size: int) -> dict[bytes, tuple[int, list[str]]]:
    """Each window with a space at either end, its number of words, and the items that have it."""
    out: dict[bytes, tuple[int, list[str]]] = {}
    for item, raw in items:
        words = words_of(raw)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            out.setdefault(b" " + b" ".join(words[k : k + n]) + b" ", (n, []))[1].append(item)
    return out


class WuManber:
    """Search for many patterns at once. The shortest pattern gives the length m that counts of each.

    ``shift`` has, for every block of bytes within the first m of a pattern, how far it is from their end; a block that no pattern has allows a step
    of m - block + 1. Where the step is 0, the bucket of that suffix block names the patterns to compare with the text.
    """

    def __init__(self, patterns: list[bytes], block: int = 8) -> None:
        self.m = min(map(len, patterns))
        self.block = min(block, self.m)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        last = self.m - self.block
        for p in patterns:
            for k in range(last + 1):
                part = p[k : k + self.block]
                self.shift[part] = min(last - k, self.shift.get(part, last + 1))
            self.buckets[p[last : self.m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, pattern) of all occurrences, by place."""
        m, block, get, buckets, free = self.m, self.block, self.shift.get, self.buckets, self.m - self.block + 1
        end, n = m, len(text)
        while end <= n:
            part = text[end - block : end]
            step = get(part, free)
            if step:
                end += step
                continue
            for p in buckets[part]:
                if text.startswith(p, end - m):
                    yield end - m, p
            end += 1


class Searcher:
    """Windows of one block of items, in two classes of length, since the shortest pattern sets the pace of its class."""

    def __init__(self, items: list[tuple[str, bytes]], size: int, short: int = 24) -> None:
        self.windows = windows(items, size)
        classes = ([p for p in self.windows if len(p) < short], [p for p in self.windows if len(p) >= short])
        self.tables = [WuManber(c) for c in classes if c]

    def hits(self, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, words) of each occurrence, and the items found; text: words with one space around each."""
        spans, items = [], set()
        for table in self.tables:
            at = word = 0
            for place, p in table.find(text):
                word += text.count(b" ", at, place)
                at = place
                n, found = self.windows[p]
                spans.append((word, n))
                items.update(found)
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, n in sorted(spans):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


def item_blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``most`` bytes, one block at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.length("t") > 0)
    for row in rows.toLocalIterator():
        raw = row.t.encode()
        if block and size + len(raw) > most:
            yield block
            block, size = [], 0
        block.append((row.i, raw))
        size += len(raw)
    yield block


FOUND = "doc_id bigint, text string, spans array<struct<a:int,n:int>>, items array<string>"
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<a:int,n:int>>"
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (first word and length of each hit window) of every row.

    The items are the stated query set: they go to the tasks in blocks of at most ``block_bytes`` (or one item), and each row passes all blocks.
    Null or empty texts have no words and no hits; null or empty items have no windows; a null item id counts as the empty string. Rows with
    null ids and repeated rows are searched each, very long texts are searched whole, items with the same window are all named, other columns are not
    read. Empty tables: no rows, or no hits.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in item_blocks(benchmark, item_id, item_text, block_bytes)]
    nothing = F.array().cast("array<struct<a:int,n:int>>"), F.array().cast("array<string>")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), nothing[0].alias("spans"), nothing[1].alias("items"))
    for k, block in enumerate(blocks):
        rows = rows.mapInArrow(_search(block, size, k == 0, k == len(blocks) - 1), RESULT if k == len(blocks) - 1 else FOUND)
    return rows


def _search(block, size: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block.value, size)
        for batch in batches:
            raw = all_bytes(batch.column(1))
            for part in slices(raw, 16 << 20):
                own, out = batch.slice(part.start, part.stop - part.start), []
                before = [([], [])] * own.num_rows if first else [([(x["a"], x["n"]) for x in s], i) for s, i in zip(own.column(2).to_pylist(), own.column(3).to_pylist())]
                for text, (spans, items) in zip(raw[part], before):
                    words = words_of(text)
                    more, found = searcher.hits(b" " + b" ".join(words) + b" ") if words else ([], set())
                    out.append((len(words), spans + more, sorted(found.union(items))))
                spans = pa.array([[{"a": a, "n": n} for a, n in x[1]] for x in out], SPANS)
                if not last:
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), spans, pa.array([x[2] for x in out], pa.list_(pa.string()))], ["doc_id", "text", "spans", "items"])
                    continue
                hit = [covered(x[1]) for x in out]
                sha = [hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in out]
                columns = [pa.array([x[0] for x in out], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), spans]
                yield pa.RecordBatch.from_arrays([own.column(0), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """The rows without a hit, with all their columns; each row passes all blocks of items. Nulls and empty tables are as for ``contamination``."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index(text)
    rows = docs
    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        rows = rows.mapInArrow(_clean(context.broadcast(items), size, at), docs.schema)
    return rows


def _clean(block, size: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block.value, size)
        for batch in batches:
            keep = [not words or not searcher.hits(b" " + b" ".join(words) + b" ")[0] for words in map(words_of, all_bytes(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
