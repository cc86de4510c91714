"""Document quality from a linear-chain conditional random field that labels every line good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import all_bytes, fold, slices

SYMBOLS = b"#*$%&|<>{}[]=_~^@+\\/"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
N_OWN = 18


def line_features(line: bytes, seen: bool) -> tuple[float, ...]:
    """What a line shows by itself; ``seen``: an earlier line of the text is equal."""
    n, words = len(line), line.split()
    symbols = (n - len(line.translate(None, SYMBOLS))) / n
    upper, lower = n - len(line.translate(None, UPPER)), n - len(line.translate(None, LOWER))
    digits = (n - len(line.translate(None, DIGITS))) / n
    shout = line.count(b"!") / len(words)
    distinct = len(set(words)) / len(words)
    length = (n - len(words) + 1) / len(words)
    return (
        1.0, min(n, 2000) / 2000, symbols, symbols > 0.02, symbols > 0.06, upper / (upper + lower + 1), upper > lower, digits, digits > 0.2,
        shout, shout > 0.3, distinct, len(words) >= 8 and distinct < 0.5, len(words) >= 8 and distinct < 0.25, min(length, 30) / 10, length > 14, seen, line[-1:] in b".!?",
    )


@dataclass
class Lines:
    """Lines with a word, of several texts one after the other: features of own, previous and next line, sizes, and the number of each text."""

    features: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Lines:
        rows, sizes, counts = [], [], []
        for raw in texts:
            before: set[bytes] = set()
            n = 0
            for line in raw.split(b"\n"):
                if line.strip():
                    rows.append(line_features(line, line in before))
                    before.add(line)
                    sizes.append(len(line))
                    n += 1
            counts.append(n)
        own = np.array(rows, np.float32).reshape(-1, N_OWN)
        return Lines(with_neighbours(own, np.array(counts)), np.array(sizes, np.float64), np.array(counts))


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    full = counts > 0
    before[starts[full]] = 0
    after[(starts + counts - 1)[full]] = 0
    return np.hstack([own, before, after])


def marginals(score: np.ndarray, change: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each line the probability of good, the expected uses of each change of label, and the log of the partition function, all texts added up.

    ``score``: of good over bad for each line; ``change[x, y]``: of label y after x. All texts step together, the longest first.
    """
    starts, order = np.cumsum(counts) - counts, np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    deepest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(deepest), side="left") if deepest else np.zeros(0, int)
    lines = np.stack([np.zeros(len(score)), score], axis=1)
    high = lines.max(axis=1, keepdims=True)
    emit, move, forward, scale = np.exp(lines - high), np.exp(change), np.zeros((len(score), 2)), np.ones(len(score))
    for t in range(deepest):
        at = starts[: active[t]] + t
        f = emit[at] * (forward[at - 1] @ move if t else 1.0)
        scale[at] = f.sum(axis=1)
        forward[at] = f / scale[at, None]
    backward, uses = np.ones((len(score), 2)), np.zeros((2, 2))
    for t in range(deepest - 1, 0, -1):
        at = starts[: active[t]] + t
        b = emit[at] * backward[at] / scale[at, None]
        uses += np.einsum("nx,xy,ny->xy", forward[at - 1], move, b)
        backward[at - 1] = b @ move.T
    total = forward * backward
    return total[:, 1] / total.sum(axis=1), uses, float(np.log(scale).sum() + high.sum())


@dataclass
class Field:
    weights: np.ndarray
    change: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text: the mean probability of its lines, weighted by their length. A text without words has that of one bare line."""
        lines = Lines.of(texts)
        good, _, _ = marginals(lines.features @ self.weights, self.change, lines.counts)
        of = np.repeat(np.arange(len(texts)), lines.counts)
        total = np.bincount(of, lines.sizes, len(texts))
        bare = 1 / (1 + np.exp(-self.weights[0]))
        return np.clip(np.where(total > 0, np.bincount(of, lines.sizes * good, len(texts)) / np.maximum(total, 1), bare), 0, 1)


def fit(lines: Lines, good: np.ndarray, rounds: int = 250, rate: float = 0.1, ridge: float = 2.0) -> Field:
    """Maximum likelihood with a ridge penalty, by gradient steps of adaptive size; each line is labelled as its text is."""
    label = np.repeat(good, lines.counts).astype(np.float64)
    x, weights, change = lines.features.astype(np.float64), np.zeros(lines.features.shape[1]), np.zeros((2, 2))
    stays = np.maximum(lines.counts - 1, 0)
    observed = np.diag([(stays * (1 - good)).sum(), (stays * good).sum()])
    m, v, n = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4), max(1, len(lines.counts))
    for k in range(1, rounds + 1):
        p, uses, _ = marginals(x @ weights, change, lines.counts)
        slope = np.concatenate([x.T @ (label - p) - ridge * weights, (observed - uses - 10 * ridge * change).ravel()]) / n
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        weights += step[:-4]
        change += step[-4:].reshape(2, 2)
    return Field(weights, change)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, quality: str, folds: int, test: int, most_docs: int, most_lines: int) -> Field:
    """Fits on labelled texts outside the test fold, whole ones, in the order of the hash of their ids: at most ``most_docs``, and as many as have
    ``most_lines`` lines together. A text that has a fiftieth of these by itself is not drawn."""
    known = labels.where((fold(doc_id, folds) != test) & F.col(doc_id).isNotNull() & F.col(quality).isin(0, 1))
    known = known.groupBy(F.col(doc_id).cast("bigint").alias("label_id")).agg(F.min(quality).cast("int").alias("good"))
    drawn = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most_docs)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("label_id"), F.col(text).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(drawn), "label_id").dropDuplicates(["label_id"])  # at most most_docs rows of two numbers
    rows = rows.withColumn("n", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))).where(F.col("n") <= most_lines // 50)
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.select("label_id", "n").withColumn("so_far", so_far).where(F.col("so_far") <= most_lines).select("label_id")  # of most_docs rows
    rows = rows.join(F.broadcast(taken), "label_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Lines.of([x]).features[:, :N_OWN].tobytes() for x in all_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["label_id", "lines", "good"])

    sample = sorted(rows.select("label_id", "text", "good").mapInArrow(features, "label_id bigint, lines binary, good int").collect())
    own = np.frombuffer(b"".join(bytes(r.lines) for r in sample), np.float32).reshape(-1, N_OWN)
    counts = np.array([len(r.lines) // (4 * N_OWN) for r in sample], np.int64)
    return fit(Lines(with_neighbours(own, counts), np.zeros(0), counts), np.array([r.good for r in sample], np.float64))


RESULT = "doc_id bigint, held_out boolean, score double"


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", folds: int = 5, test: int = 0, least: float = 0.3, most_docs: int = 4_000, most_lines: int = 200_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is ``least`` or more) of every row.

    The score is the length-weighted mean of the lines' probabilities of being good. Null texts and texts without words have the score of one bare
    line. Rows with null ids are scored and not learned from, nor are labels other than 0 and 1; of several labels of an id the least counts;
    repeated rows are scored each; very long texts are scored whole; other columns are not read; an empty table gives no rows, and without labels all lines are as likely good as bad.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, doc_id, text, quality, folds, test, most_docs, most_lines))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (fold(doc_id, folds) == test).alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = all_bytes(batch.column(2))
            found = [model.value.scores(raw[part]) for part in slices(raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *found]))], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, RESULT).withColumn("predicted", (F.col("score") >= least).cast("int"))
