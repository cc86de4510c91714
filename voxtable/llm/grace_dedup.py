"""Exact deduplication as a Grace hash: records are dealt to spill files by a hash of their content, files that are too large are dealt again by another
hash, and what fits goes through an open-addressing table that compares complete contents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import all_bytes, free
from voxtable.session import scratch_path

#: Spark's own limit of buckets in a table.
MOST_BUCKETS = 100_000
#: A file with one hash only is dealt by its position once it holds more entries than this.
FEW = 64


class ContentTable:
    """Open addressing with linear probing. A content gets the number of its first appearance; contents are one if all their bytes are."""

    def __init__(self) -> None:
        self.slots, self.contents, self.marks = [-1] * 64, [], []

    def number(self, content: bytes) -> int:
        mark = hash(content)
        slots, mask = self.slots, len(self.slots) - 1
        at = mark & mask
        while (k := slots[at]) >= 0:
            if self.marks[k] == mark and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.contents.append(content)
        self.marks.append(mark)
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, mark in enumerate(self.marks):
            at = mark & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def larger(a: int | None, b: int | None) -> bool:
    """Whether id a goes before id b; null comes last."""
    return a is not None and (b is None or a > b)


def _combine(names: dict[str, str], run_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds the copies within runs of rows of about ``run_bytes``. Each distinct content of a run is an entry; the row of its largest id carries it."""

    def run(batches: list[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        table, entries, best, copies = ContentTable(), [], [], []
        place = 0
        for batch in batches:
            for i, content in zip(batch.column(names["id"]).to_pylist(), all_bytes(batch.column(names["content"]))):
                k = table.number(content)
                entries.append(k)
                if k == len(best):
                    best.append((i, place))
                    copies.append(1)
                else:
                    copies[k] += 1
                    if larger(i, best[k][0]):
                        best[k] = (i, place)
                place += 1
        digests = [hashlib.sha256(c).digest() for c in table.contents]
        carrier = {p: k for k, (_, p) in enumerate(best)}
        place = 0
        for batch in batches:
            here = [carrier.get(p) for p in range(place, place + batch.num_rows)]
            mine = entries[place : place + batch.num_rows]
            place += batch.num_rows
            carries = pa.array([k is not None for k in here])
            columns = {n: batch.column(n) for n in batch.schema.names if n != names["part"]}
            for n in {names["text"], names["content"]}:
                columns[n] = pc.if_else(carries, columns[n], pa.scalar(None, columns[n].type))
            columns[names["entry"]] = pa.array([first + k for k in mine], pa.int64())
            columns[names["copies"]] = pa.array([None if k is None else copies[k] for k in here], pa.int64())
            columns[names["size"]] = pa.array([None if k is None else len(table.contents[k]) for k in here], pa.int64())
            columns[names["digest"]] = pa.array([None if k is None else digests[k] for k in here], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(names["part"])[0].as_py() << 33 if first is None else first
                held.append(batch)
                size += batch.nbytes
            if size > run_bytes:
                yield from run(held, first)
                first += sum(b.num_rows for b in held)
                held, size = [], 0
        if held:
            yield from run(held, first)

    return combine


def _classes(names: dict[str, str]) -> Callable:
    """The groups of one bucket: (entry, keep_entry, keep_id, group_size, digest) of each entry in it."""

    def classes(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, numbers, entries = ContentTable(), [], []
        best, total, digests = [], [], []
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(names[n])).to_pylist()
            contents = all_bytes(batch.column(batch.schema.get_field_index(names["content"])))
            for entry, i, n, digest, content in zip(get("entry"), get("id"), get("copies"), get("digest"), contents):
                k = table.number(content)
                numbers.append(k)
                entries.append(entry)
                if k == len(best):
                    best.append((i, entry))
                    total.append(n)
                    digests.append(digest)
                else:
                    total[k] += n
                    if larger(i, best[k][0]) or (i == best[k][0] and entry < best[k][1]):
                        best[k] = (i, entry)
        for start in range(0, len(entries), 100_000):
            part = numbers[start : start + 100_000]
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array(entries[start : start + 100_000], pa.int64()),
                "keep_entry": pa.array([best[k][1] for k in part], pa.int64()),
                "keep_id": pa.array([best[k][0] for k in part], pa.int64()),
                "group_size": pa.array([total[k] for k in part], pa.int64()),
                "digest": pa.array([digests[k] for k in part], pa.binary()),
            })

    return classes


CLASSES = "entry bigint, keep_entry bigint, keep_id bigint, group_size bigint, digest binary"


class Grace:
    """One run over a table: the spill files and the classes found in them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, normal: Callable[[Column], Column] | None, bucket_bytes: int, run_bytes: int) -> None:
        self.spark, self.bucket_bytes = docs.sparkSession, bucket_bytes
        have = docs.withColumn(free(docs, "content")[0], normal(F.col(text))) if normal else docs
        self.names = dict(zip(("part", "entry", "copies", "size", "digest", "bucket"), free(have, "part", "entry", "copies", "size", "digest", "bucket")))
        self.names |= {"id": doc_id, "text": text, "content": have.columns[-1] if normal else text}
        n = self.names
        whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.n_buckets = self._fan_out(whole)
        kept = have.drop(n["part"]).schema.simpleString()[7:-1]
        schema = f"{kept}, {n['entry']} bigint, {n['copies']} bigint, {n['size']} bigint, {n['digest']} binary"
        rows = have.withColumn(n["part"], F.spark_partition_id().cast("bigint")).mapInArrow(_combine(n, run_bytes), schema)
        # rows that carry no content lie by their entry, so that no copies of one text meet in a file
        dealt = F.when(F.col(n["digest"]).isNull(), F.xxhash64(n["entry"])).otherwise(F.xxhash64(n["digest"], F.lit(0)))
        self.rows = self._spill(rows.withColumn(n["bucket"], F.pmod(dealt, F.lit(self.n_buckets)).cast("int")), self.n_buckets)

    def _fan_out(self, size: int) -> int:
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return min(MOST_BUCKETS, max(least, -(-2 * size // self.bucket_bytes)))

    def _spill(self, rows: DataFrame, buckets: int) -> DataFrame:
        """The rows as files of their buckets in the shared folder."""
        path = scratch_path(self.spark, "spill")
        name = "spill_" + path.rsplit("-", 1)[1]
        bucket = self.names["bucket"]
        rows.repartition(buckets, bucket).write.format("parquet").option("path", path).bucketBy(buckets, bucket).saveAsTable(name)
        return self.spark.table(name)

    def classes(self) -> DataFrame:
        """entry, keep_entry, keep_id, group_size, digest of every entry."""
        n = self.names
        entries = self.rows.where(F.col(n["digest"]).isNotNull()).select(*{n[k] for k in ("id", "entry", "copies", "size", "digest", "content", "bucket")})
        return self._resolve(entries, 1)

    def _table(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy(self.names["bucket"]).applyInArrow(_classes(self.names), CLASSES)

    def _resolve(self, entries: DataFrame, level: int) -> DataFrame:
        n = self.names
        bucket, digest, size = n["bucket"], n["digest"], n["size"]
        alike = F.min(digest) == F.max(digest)
        sizes = entries.groupBy(bucket).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"), alike.alias("alike"))
        over = sizes.where((F.col("bytes") > self.bucket_bytes) & (F.col("n") > F.when(F.col("alike"), FEW).otherwise(1)))
        found = over.groupBy("alike").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()  # two rows at most
        if not found:
            return self._table(entries)
        out = self._table(entries.join(over, bucket, "left_anti"))
        for kind, whole, rows in found:
            deep = entries.join(over.where(F.col("alike") == kind).select(bucket), bucket, "left_semi")
            if kind:
                out = out.unionByName(self._copies(deep, rows, level))
            else:
                buckets = self._fan_out(whole)
                deep = deep.withColumn(bucket, F.pmod(F.xxhash64(digest, F.lit(level)), F.lit(buckets)).cast("int"))
                out = out.unionByName(self._resolve(self._spill(deep, buckets), level + 1))
        return out

    def _copies(self, entries: DataFrame, rows: int, level: int) -> DataFrame:
        """Entries whose hash no dealing tells apart: dealt by position, so that a task meets a few copies each, of which one goes on."""
        n = self.names
        buckets = min(MOST_BUCKETS, -(-rows // 8))
        dealt = self._spill(entries.withColumn(n["bucket"], F.pmod(F.xxhash64(n["entry"], F.lit(level)), F.lit(buckets)).cast("int")), buckets)
        path = scratch_path(self.spark, "copies")
        self._table(dealt).write.parquet(path)
        met = self.spark.read.schema(CLASSES).parquet(path)
        firsts = met.where("entry = keep_entry").select(F.col("entry").alias(n["entry"]), F.col("group_size").alias("met_"))
        rest = dealt.join(firsts, n["entry"]).withColumn(n["copies"], F.col("met_")).drop("met_")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rest = self._spill(rest.withColumn(n["bucket"], F.pmod(F.xxhash64(n["digest"], F.lit(level)), F.lit(buckets)).cast("int")), buckets)
        ends = self._resolve(rest, level + 1).withColumnRenamed("entry", "first_").withColumnRenamed("keep_entry", "end_")
        led = met.select("entry", F.col("keep_entry").alias("first_")).join(ends, "first_")
        return led.select("entry", F.col("end_").alias("keep_entry"), "keep_id", "group_size", "digest")


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] | None = None, bucket_bytes: int = 128 << 20, run_bytes: int = 32 << 20
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too.

    Rows are equal if their texts are after ``normal`` (as they are, if it is not given); null counts as empty. Of equal texts the row with the largest
    id stays, null ids coming last; of rows alike in id and text one stays. A bucket holds at most ``bucket_bytes`` of distinct contents; a text
    longer than that is a bucket of its own. Other columns are not read; an empty table gives no rows.
    """
    grace = Grace(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", normal, bucket_bytes, run_bytes)
    rows = grace.rows.select("doc_id", "entry", F.col("digest").isNotNull().alias("carries"))
    out = rows.join(grace.classes(), "entry")
    kept = (F.col("entry") == F.col("keep_entry")) & F.col("carries")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] | None = None, bucket_bytes: int = 128 << 20, run_bytes: int = 32 << 20
) -> DataFrame:
    """The rows that stay, with all their columns as they were; a null text that stays is null."""
    grace = Grace(docs, doc_id, text, normal, bucket_bytes, run_bytes)
    stay = grace.classes().where("entry = keep_entry").select(F.col("entry").alias(grace.names["entry"]))
    carriers = grace.rows.where(F.col(grace.names["digest"]).isNotNull())
    return carriers.join(stay, grace.names["entry"], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
