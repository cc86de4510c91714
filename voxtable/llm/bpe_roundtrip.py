"""BPE encoding and decoding; long text without white space by tree concatenation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import Pieces, Tokens, all_bytes, common_token, reach_of, slices, token_spans, tokenizer


def joined(encode, text: str, left: Tokens, right: Tokens, begin: int, middle: int, end: int, window: int, reach: int) -> Tokens:
    """The tokens of text[begin:end] from those of its two parts, which meet at ``middle``.

    A window around the join is encoded, twice as wide each time, until it has a token in common with either side; a window as wide as the
    text is the answer itself. What stands within ``reach`` characters of a cut is not trusted.
    """
    while True:
        a, b = max(begin, middle - window), min(end, middle + window)
        around = token_spans(encode(text[a:b]), a)
        if a == begin and b == end:
            return around
        near = next((k for k in range(len(left), 0, -1) if left[k - 1][0] < a), 0)
        one = (-1, -1) if a == begin else common_token(left[near:], around, a + reach, middle - reach)
        if one is not None:
            lead = [] if a == begin else left[: near + one[0] + 1]
            rest = around[one[1] + 1 :]
            if b == end:
                return lead + rest
            two = common_token(rest, right, middle + reach, b - reach)
            if two is not None:
                return lead + rest[: two[0] + 1] + right[two[1] + 1 :]
        window *= 2


def tree(encode, encode_all, text: str, leaf: int, reach: int, window: int = 64) -> Tokens:
    """Tokens of a long text: leaves are encoded side by side, then joined by twos, level by level."""
    cuts = list(range(0, len(text), leaf)) + [len(text)]
    parts = [(a, b, token_spans(e, a)) for a, b, e in zip(cuts, cuts[1:], encode_all([text[a:b] for a, b in zip(cuts, cuts[1:])]))]
    while len(parts) > 1:
        pairs = [(x[0], y[1], joined(encode, text, x[2], y[2], x[0], x[1], y[1], window, reach)) for x, y in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(parts) // 2 * 2 :]
    return parts[0][2] if parts else []


class Codec:
    """Ids and decoded form of pieces without ASCII white space."""

    def __init__(self, path: str, unsplit: int) -> None:
        self.model, self.unsplit = tokenizer(path), unsplit
        self.plain, self.reach = self.model.decoder is None, reach_of(self.model)

    def encode(self, text: str):
        return self.model.encode(text, add_special_tokens=False)

    def ids(self, part: list[str]) -> list[list[int]]:
        short = [x for x in part if len(x) <= self.unsplit]
        found = dict(zip(short, (e.ids for e in self.model.encode_batch_fast(short, add_special_tokens=False))))
        batch = lambda texts: self.model.encode_batch(texts, add_special_tokens=False)
        return [found[x] if x in found else [i for _, _, i in tree(self.encode, batch, x, self.unsplit, self.reach)] for x in part]

    def learn(self, part: list[str]) -> list[tuple[int, bytes, bytes]]:
        name = self.model.id_to_token
        return [(len(ids), " ".join(map(str, ids)).encode(), " ".join(map(name, ids)).encode() if self.plain else b"") for ids in self.ids(part)]

    def decode(self, ids: bytes, pieces: list[bytes]) -> bytes:
        """As decode(ids, skip_special_tokens=False): without a decoder the tokens joined by spaces, else the library's own."""
        if self.plain:
            return b" ".join(pieces)
        return self.model.decode([int(x) for x in ids.split()], skip_special_tokens=False).encode()


@lru_cache(1)
def codec_of(path: str, unsplit: int) -> tuple[Codec, Pieces]:
    """One codec and one bounded memory of pieces for all tasks that a Python worker runs."""
    codec = Codec(path, unsplit)
    return codec, Pieces(codec.learn, 200_000)


def bpe_roundtrip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", unsplit: int = 512, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with ``texts`` also ids (space-separated) and decoded themselves.

    The tokenizer is one that drops white space (its pieces are independent). Pieces of over ``unsplit`` characters go through ``tree``. A null
    text is empty: no tokens, and the digests of the empty string. A null id stays null, repeated rows are encoded each, other columns are not
    read, an empty table gives no rows. Memory: an Arrow batch, a bounded memory of pieces, and one text's output.
    """
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds += [("ids", pa.string()), ("decoded", pa.string())] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memory = codec_of(path, unsplit)
        for batch in batches:
            raw, keys = all_bytes(batch.column(1)), batch.column(0)
            for part in slices(raw):
                split = [x.split() for x in raw[part]]
                known, rows = memory.look_up(split), []
                for words in split:
                    found = [k for k in map(known.__getitem__, words) if k[0]]
                    ids = b" ".join([k[1] for k in found])
                    decoded = codec.decode(ids, [k[2] for k in found])
                    rows.append((sum([k[0] for k in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids.decode(), decoded.decode()) if texts else ())))
                own = keys.slice(part.start, part.stop - part.start).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own, *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds[1:]))], [n for n, _ in kinds])

    schema = ", ".join(f"{n} {'bigint' if k == pa.int64() else 'string'}" for n, k in kinds)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
