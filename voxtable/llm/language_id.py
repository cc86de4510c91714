"""Language identification by the nearest of several centroids per language, in TF-IDF vectors of byte trigrams, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import all_bytes, fold, slices

LETTER = re.compile(r"[^\W\d_]")  # and numerals that are no digits
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def counts_of(raw: bytes, dims: int) -> np.ndarray:
    """How often each bin of hashed trigrams occurs in the lower-cased text, with runs of other ASCII characters as one space."""
    a = np.frombuffer(b" " + b" ".join(raw.translate(LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    grams = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2_654_435_761) >> np.uint32(32 - dims.bit_length() + 1)
    return np.bincount(grams, minlength=dims)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


def has_letter(raw: bytes) -> bool:
    """Whether a character of the Unicode categories of letters occurs; numerals such as one half or a Roman eight are none."""
    return any(m[0].isalpha() for m in LETTER.finditer(raw.decode("utf-8", "replace")))


@dataclass
class Centroids:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray  # the least cosine to a centroid that isn't rejected, for a text of many trigrams

    def predict(self, raw: bytes | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether the text is too far away from all languages."""
        if raw is None or not has_letter(raw) or not self.langs:
            return "und", 0.0, True
        counts = counts_of(raw, len(self.idf))
        near = self.centroids @ vector(counts, self.idf)
        best = int(np.argmax(near))
        share = np.sqrt(min(1.0, counts.sum() / 1000))  # short texts have few of the trigrams of their language
        return self.langs[best], float(np.round(min(1.0, max(0.0, float(near[best]))), 6)), bool(near[best] < self.least[best] * share)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and the cosine of each row to its own. Starts from the mean and, each time, the row farthest from all."""
    mean = rows.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-9)]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.argmin((rows @ np.array(centres).T).max(axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(rows @ c.T, axis=1)
        c = np.array([rows[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (rows @ c.T).max(axis=1)


def fit(docs: DataFrame, text: str, lang: str, seed_column: Column, dims: int, per_lang: int, k: int, most_langs: int) -> Centroids:
    """Document frequencies come from all rows given; centroids from a sample of about ``per_lang`` rows of each language, by the hash of a row.

    The sample of a language is clustered in a task of its own (``per_lang`` vectors of ``dims`` numbers on average); the driver gets the centroids.
    Up to ``most_langs`` languages the shares to draw are part of the plan, beyond that they are joined.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counted = known.groupBy(F.col(lang).alias("counted_lang")).agg(F.count("*").alias("counted_rows"))
    totals = {r[0]: r[1] for r in counted.limit(most_langs + 1).collect()}

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            raw = all_bytes(batch.column(0))
            n += len(raw)
            for x in raw:
                df += counts_of(x, dims) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], ["gram", "n"])

    frequencies = np.zeros(dims + 1, np.int64)
    for r in known.select(F.col(text)).mapInArrow(document_frequencies, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        frequencies[r.gram + 1] = r.n
    idf = np.log((1 + frequencies[0]) / (1 + frequencies[1:])) + 0.1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, langs = all_bytes(batch.column(1)), batch.column(0).to_pylist()
            for part in slices(raw):
                found = [(g, vector(counts_of(x, dims), idf).tobytes()) for g, x in zip(langs[part], raw[part]) if has_letter(x)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], ["lang", "vector"])

    place = F.pmod(seed_column, F.lit(1_000_003)) / 1_000_003
    if len(totals) > most_langs:
        drawn = known.join(counted, F.col(lang) == F.col("counted_lang")).where(place < per_lang / F.col("counted_rows"))
    else:
        share = F.create_map(*(F.lit(x) for g, n in totals.items() for x in (g, min(1.0, per_lang / n)))) if totals else F.create_map(F.lit(""), F.lit(0.0))
        drawn = known.where(place < F.coalesce(share[F.col(lang)], F.lit(0.0)))

    def cluster(table: pa.Table) -> pa.Table:
        own = sorted(table.column("vector").to_pylist())  # the order of rows must not matter
        c, near = clustered(np.frombuffer(b"".join(own), np.float32).reshape(-1, dims), k)
        return pa.table([table.column("lang").slice(0, 1), pa.array([c.astype(np.float32).tobytes()], pa.binary()), pa.array([0.35 * float(np.median(near))])], ["lang", "centroids", "least"])

    sample = drawn.select(F.col(lang).alias("l"), F.col(text).alias("t")).mapInArrow(vectors, "lang string, vector binary")
    found = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, centroids binary, least double").collect())
    centroids = [np.frombuffer(bytes(r.centroids), np.float32).reshape(-1, dims) for r in found]
    langs = [r.lang for r, c in zip(found, centroids) for _ in c]
    least = [r.least for r, c in zip(found, centroids) for _ in c]
    return Centroids(idf, np.vstack(centroids) if centroids else np.zeros((0, dims), np.float32), langs, np.array(least))


RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, test: int = 2, dims: int = 4096, per_lang: int = 400, centroids: int = 4, most_langs: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid) and rejected (too far from every language, or nothing to go by) of every row.

    Learns from rows outside the test fold that have a language. Null texts and texts without a letter are ``und`` with score 0 and rejected, as are
    all texts if there is nothing to learn from. Of equally near centroids the first goes, languages being in order. Rows with null ids are learned from
    and never held out; repeated rows are judged each; very long texts are read whole; other columns are not read; an empty table gives no rows.
    """
    model = model_of(docs, doc_id, text, lang, folds, test, dims, per_lang, centroids, most_langs)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (fold(doc_id, folds) == test).alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predict(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, RESULT)


def model_of(docs: DataFrame, doc_id: str, text: str, lang: str, folds: int, test: int, dims: int, per_lang: int, centroids: int, most_langs: int):
    """The fitted model as a broadcast: idf and centroids, bounded by dims * centroids * most_langs numbers."""
    train = docs.where(fold(doc_id, folds) != test)
    seed = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    return docs.sparkSession.sparkContext.broadcast(fit(train, text, lang, seed, dims, per_lang, centroids, most_langs))


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that are not rejected, with all their columns; null texts and texts without a letter are rejected."""
    model = model_of(docs, doc_id, text, lang, 4, 2, 4096, 400, 4, 400)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            yield batch.filter(pa.array([not own.predict(x)[2] for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
