"""Near duplicates by the Jaccard similarity of word shingles: a MinHash LSH forest finds candidates, their shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import all_bytes, checkpoint, free

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all windows of ``size`` words; fewer words are one window."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * ODD + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


class Forest:
    """``trees`` tries over MinHash signatures; a node is a prefix of a tree's signature."""

    def __init__(self, trees: int, deepest: int, threshold: float, recall: float, seed: int = 11) -> None:
        self.trees, self.depth = trees, self.shortened(trees, deepest, threshold, recall)
        draw = np.random.default_rng(seed)
        n = trees * self.depth
        self.flip, self.times = draw.integers(0, 2**32, n, np.uint32), draw.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)

    @staticmethod
    def shortened(trees: int, deepest: int, threshold: float, recall: float) -> int:
        """Prefixes are shortened from the deepest level until a pair at the threshold shares one in some tree with the wanted probability."""
        depth = deepest
        while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
            depth -= 1
        return depth

    def prefixes(self, own: np.ndarray) -> np.ndarray:
        """A key for the node that a set reaches in each tree."""
        low = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        short = (own >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(short), 2048):
            low = np.minimum(low, ((short[k : k + 2048, None] ^ self.flip) * self.times).min(axis=0))
        key = np.arange(self.trees, dtype=np.uint64)
        for part in low.reshape(self.trees, self.depth).T.astype(np.uint64):
            key = mixed(key * ODD + part)
        return key.view(np.int64)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


SIGNED = "doc_id bigint, text_key bigint, digest binary, size bigint, nodes array<bigint>"


def signed(docs: DataFrame, doc_id: str, text: str, size: int, forest: Forest) -> DataFrame:
    """A row for each document: a digest of its words, its number of shingles, and the nodes it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, nodes = [], [], []
            for raw in all_bytes(batch.column(2)):
                words = words_of(raw)
                own = shingles(words, size)
                digests.append(digest_of(words))
                sizes.append(len(own))
                nodes.append(forest.prefixes(own) if len(own) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *nodes])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_key", "digest", "size", "nodes"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def components(edges: DataFrame, most_rounds: int = 60, parts: int = 16) -> DataFrame:
    """id, root (the least id of its component) of every id in the edges (a, b); ids without edges don't appear.

    Alternates large and small stars: each id hangs its larger neighbours, then its smaller ones and itself, on the least of them. Rounds grow with
    the logarithm of the longest path; each is an aggregation with map-side combine and a join, and ends in a checkpoint.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = checkpoint(edges), None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # the neighbours of one id may be very many: they meet its least neighbour in parts
        least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        both = both.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
        large = both.join(least, ["a", "part"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = checkpoint(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = now
    raise RuntimeError("components did not settle")


def overlap_counts(sets: list[np.ndarray], rows: slice, columns: slice, slab: int = 4096) -> np.ndarray:
    """How many shingles each set of ``rows`` shares with each of ``columns``, by products of 0/1 matrices of a slab of shingles at a time."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = (times > 1)[which]
    at, which, total = at[keep], shared[which[keep]], int((times > 1).sum())
    order = np.argsort(which, kind="stable")
    at, which = at[order], which[order]
    out = np.zeros((len(range(*rows.indices(len(sets)))), len(range(*columns.indices(len(sets))))), np.float32)
    for low in range(0, total, slab):
        a, b = np.searchsorted(which, [low, low + slab])
        m = np.zeros((len(sets), min(slab, total - low)), np.float32)
        m[at[a:b], which[a:b] - low] = 1
        out += m[rows] @ m[columns].T
    return out


VERIFIED = "a bigint, b bigint, links bigint"


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, null, links) with the links of a in one pair of chunks, and (a, b, 0): enough links to connect what the pair of chunks connects.

    blocks: root, i, j (a pair of chunks of a component, i <= j), side (the chunk), id, copies, and the shingles. Rows of a pair stand together.
    """

    def of(rows: list[tuple]) -> Iterator[tuple]:
        i, j = rows[0][1], rows[0][2]
        rows.sort(key=lambda r: (r[3], r[4]))
        n = sum(r[3] == i for r in rows)
        sets, sizes = [r[6] for r in rows], np.array([len(r[6]) for r in rows])
        left, right = (slice(0, n), slice(0, n) if i == j else slice(n, len(rows)))
        if i != j and n in (0, len(rows)):
            return
        shared = overlap_counts(sets, left, right)
        # shared / (|a| + |b| - shared) >= t, in whole hundredths so that no rounding decides
        hit = shared * (100 + round(100 * threshold)) >= round(100 * threshold) * (sizes[left][:, None] + sizes[right][None, :])
        if i == j:
            np.fill_diagonal(hit, False)
        copies = np.array([r[5] for r in rows], np.int64)
        ids = [r[4] for r in rows]
        for k, found in enumerate(hit @ copies[right]):
            if found:
                yield ids[left][k], None, int(found)
        if i != j:
            for k, found in enumerate(copies[left] @ hit):
                if found:
                    yield ids[right][k], None, int(found)
        seen_left, seen_right = np.zeros(hit.shape[0], bool), np.zeros(hit.shape[1], bool)
        for start in range(hit.shape[0]):  # breadth first; each new one is linked to one that was reached before
            if seen_left[start] or not hit[start].any():
                continue
            seen_left[start] = True
            queue = [start]
            while queue:
                k = queue.pop()
                fresh = np.flatnonzero(hit[k] & ~seen_right)
                seen_right[fresh] = True
                for r in fresh:
                    yield ids[left][k], ids[right][r], 0
                    more = np.flatnonzero(hit[:, r] & ~seen_left)
                    seen_left[more] = True
                    for x in more:
                        yield ids[left][x], ids[right][r], 0
                    queue += more.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])

        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in range(6)]
            lists = batch.column(6)
            for k in range(batch.num_rows):
                row = (*(c[k] for c in plain), np.asarray(lists[k].values).view(np.uint64))
                if group and group[0][:3] != row[:3]:
                    out.extend(of(group))
                    group = []
                    if len(out) > 10_000:
                        yield flushed()
                group.append(row)
        if group:
            out.extend(of(group))
        yield flushed()

    return blocks.mapInArrow(run, VERIFIED)


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """The columns of ``wanted`` (some texts, by digest and the id and text key of one document that has it) with their shingles."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d_"), F.xxhash64(text).alias("k_"), F.col(text).alias("t_"))
    rows = rows.join(wanted, F.col("d_").eqNullSafe(F.col("doc_id")) & (F.col("k_") == F.col("text_key"))).select("id", "root", "copies", "digest", "t_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(raw) for raw in all_bytes(batch.column(4))]
            lists = pa.array([shingles(w, size).view(np.int64) if digest_of(w) == d else None for w, d in zip(words, batch.column(3).to_pylist())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), lists], ["id", "root", "copies", "shingles"])

    return rows.mapInArrow(run, "id bigint, root bigint, copies bigint, shingles array<bigint>").where("shingles is not null").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 12, recall: float = 0.999, chunk: int = 200_000, chunk_texts: int = 256) -> DataFrame:
    """doc_id, text_key, copy_of, class_id and n_links of every row.

    Words are separated by ASCII white space, with A-Z lower-cased; texts of the same words are copies, and ``copy_of`` is the least doc_id among
    them. A link joins two rows whose shingle sets have a Jaccard similarity of ``threshold`` (in hundredths) or more, copies included; n_links
    counts a row's links, class_id is the least doc_id of all rows that links connect. Texts without words have no links and are classes of
    one text, whose rows share it. Every pair that shares a node of the forest is verified on whole sets of 64-bit shingle hashes: the pairs of a
    connected part of candidates meet in pairs of chunks of about ``chunk`` shingles or ``chunk_texts`` texts each, and only counts and connecting links leave the task.
    Null texts are empty; rows with null ids take part (a class of nothing else has a null class_id); repeated rows are copies of each other;
    of very long texts all shingles count; other columns are not read; an empty table gives no rows.
    """
    forest = Forest(trees, deepest, threshold, recall)
    rows = checkpoint(signed(docs, doc_id, text, size, forest))
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    texts = rows.groupBy("digest").agg(F.count("*").alias("copies"), first.alias("one"), F.max("size").alias("size"), F.first("nodes").alias("nodes"))
    texts = checkpoint(texts.select(F.monotonically_increasing_id().alias("id"), "digest", "copies", "one.*", "size", "nodes"))

    reached = texts.select("id", F.explode("nodes").alias("node"))
    hubs = reached.groupBy("node").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("node", "hub")
    parts = checkpoint(components(reached.join(hubs, "node").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()))

    wanted = parts.join(texts.select("id", "digest", "copies", "doc_id", "text_key", "size"), "id")
    chunks = wanted.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / chunk), F.ceil(F.count("*") / chunk_texts)).cast("int").alias("chunks"))
    sets = shingle_sets(docs, wanted, doc_id, text, size).join(chunks, "root").withColumn("side", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    blocks = sets.select("root", "side", "id", "copies", "shingles", pair)
    blocks = blocks.select("root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "copies", "shingles")
    found = checkpoint(verified(blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), threshold))

    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    roots = components(found.where("b is not null").select("a", "b"))
    named = texts.select("id", "digest", "copies", "doc_id", "size").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.join(least, "root").select("digest", F.col("doc_id").alias("copy_of"), "class_id", F.when(F.col("size") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"))
    return rows.select("doc_id", "text_key", "digest").join(named, "digest").select("doc_id", "text_key", "copy_of", "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each class the row with the least id (null ids last; of rows alike in id and text, one).
    Null and empty texts are copies of each other, so that one of them stays."""
    found = near_duplicates(docs, doc_id, text, **settings)
    # a class of rows without ids is told apart by its text
    group = F.struct("class_id", F.when(F.col("class_id").isNull(), F.col("text_key")))
    stay = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("m"))
    d, k = free(docs, "stay_id_", "stay_key_")
    stay = stay.select(F.col("m.doc_id").alias(d), F.col("m.text_key").alias(k))
    name: Column = docs[doc_id].cast("bigint")
    kept = docs.join(stay, name.eqNullSafe(stay[d]) & (F.xxhash64(docs[text]) == stay[k]))
    return kept.dropDuplicates([d, k]).select(*(F.col(f"`{c}`") for c in docs.columns))
