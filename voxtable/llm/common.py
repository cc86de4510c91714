"""What the text operators share: reading tables, folds by document id, stable boundaries of a BPE tokenizer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (start, end, id) of each token, in characters of the text.
Tokens = list[tuple[int, int, int]]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null value is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that the table has already (Spark compares names without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def all_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir."""
    from voxtable.session import cut_lineage

    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a table of its own in the shared folder of the checkpoints and read again."""
    from voxtable import session

    return session.stored(df)


def tokenizer(path: str):
    """A tokenizers.Tokenizer from its file, without truncation or padding; Spark alone shares out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def token_spans(encoding, shift: int = 0) -> Tokens:
    return [(a + shift, b + shift, i) for (a, b), i in zip(encoding.offsets, encoding.ids)]


def alone(tokens: Tokens) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """Tokens whose characters no neighbour shares (bytes of one character may be several tokens)."""
    for k, (a, b, i) in enumerate(tokens):
        if b > a and (k == 0 or tokens[k - 1][1] <= a) and (k + 1 == len(tokens) or tokens[k + 1][0] >= b):
            yield k, (a, b, i)


def reach_of(model) -> int:
    """How far what stands beside a token can decide how it is cut out: the longest special string, a contraction at least."""
    return max([4, *(len(x.content) for x in model.get_added_tokens_decoder().values())])


def common_token(left: Tokens, right: Tokens, low: int, high: int) -> tuple[int, int] | None:
    """Positions, in both lists, of the last token between the characters ``low`` and ``high`` that both encodings have at the same place.

    This is what proves a splice. A sequence of tokens is the BPE encoding of its text if and only if each two neighbours are the encoding of
    their own text: the first merge across a border between neighbours would depend on these two alone, as merges elsewhere touch neither.
    With a token in common, every two neighbours of left up to it and right from it on stand side by side in a true encoding.
    The callers keep ``low`` and ``high`` at least ``reach_of`` characters away from where a text was cut off.
    """
    at = {token: k for k, token in alone(right) if low <= token[0] and token[1] <= high}
    return next(((k, at[token]) for k, token in reversed(list(alone(left))) if token in at), None)


class Pieces:
    """A bounded memory of what a function gives for each piece between ASCII white space, filled by whole batches. When it is full, what the
    texts at hand use stays.

    White space of that kind separates the pieces for good: normalisation doesn't reach across it, and no token holds it.
    """

    def __init__(self, learn: Callable[[list[str]], list], most: int = 300_000) -> None:
        self.learn, self.most, self.known = learn, most, {}

    def look_up(self, texts: list[list[bytes]]) -> dict[bytes, object]:
        used = set().union(*texts)
        order = list(used.difference(self.known))
        if len(self.known) + len(order) > self.most:
            self.known = {x: self.known[x] for x in used.intersection(self.known)}
        for k in range(0, len(order), 20_000):
            part = order[k : k + 20_000]
            self.known.update(zip(part, self.learn([x.decode("utf-8", "replace") for x in part])))
        return self.known


def slices(texts: list[bytes], most: int = 4 << 20) -> Iterator[slice]:
    """Runs of texts of about ``most`` bytes, so that a batch of long texts is never worked on at once."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
