"""Token counts of whole texts; long ones by overlapping chunks that are spliced where both encodings have a token in common."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import Pieces, Tokens, all_bytes, common_token, reach_of, slices, token_spans, tokenizer

RESULT = "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chunks bigint"


def spliced(encode, text: str, size: int, overlap: int, reach: int) -> tuple[Tokens, int]:
    """The tokens of a text from chunks of ``size`` characters, and the number of chunks encoded.

    Each chunk goes back over the last ``overlap`` characters of the one before it. Without a token in common there, the overlap is doubled; if
    it has grown to the chunk and nothing aligns, the text is done again with chunks twice as long, in the end as one.
    """
    spent = 0
    while size < len(text):
        out: Tokens = []
        left, start, stop, failed = token_spans(encode(text[:size])), 0, size, False
        spent += 1
        while stop < len(text) and not failed:
            width, at = overlap, None
            while at is None and not failed:
                begin, end = max(start + 1, stop - width), min(len(text), stop + size)
                right = token_spans(encode(text[begin:end]), begin)
                spent += 1
                within = next((k for k in range(len(left), 0, -1) if left[k - 1][0] < begin), 0)
                at = common_token(left[within:], right, begin + reach, stop - reach)
                failed = at is None and width >= stop - start - 1
                width *= 2
            if at is not None:
                out += left[: within + at[0] + 1]
                left, start, stop = right[at[1] + 1 :], begin, end
        if not failed:
            return out + left, spent
        size *= 2
    return token_spans(encode(text)), spent + 1


@lru_cache(1)
def counter_of(path: str):
    """One tokenizer and one bounded memory of pieces for all tasks that a Python worker runs."""
    model = tokenizer(path)
    return model, Pieces(lambda part: [len(x.ids) for x in model.encode_batch_fast(part, add_special_tokens=False)])


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", huge: int = 12_000, chunk: int = 4_096, overlap: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_chunks (chunks encoded; 0 for texts of at most ``huge`` bytes, which are one) of every row.

    Special strings inside texts are handled as the tokenizer does by default; none are added. A null text counts as empty: 0 bytes, 0 tokens.
    A null id stays null, repeated rows are counted each, other columns are not read, an empty table gives no rows. The tokenizer's file must
    be on every executor, as an installed package is. Memory: an Arrow batch, a bounded memory of pieces, and the tokens of one huge text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = counter_of(path)
        for batch in batches:
            raw = all_bytes(batch.column(1))
            counts, chunks = [0] * len(raw), [0] * len(raw)
            for run in slices(raw):
                small = [(k, raw[k].split()) for k in range(run.start, run.stop) if len(raw[k]) <= huge]
                known = memory.look_up([words for _, words in small])
                for k, words in small:
                    counts[k] = sum(map(known.__getitem__, words))
                for k in range(run.start, run.stop):
                    if len(raw[k]) > huge:
                        tokens, chunks[k] = spliced(lambda s: model.encode(s, add_special_tokens=False), raw[k].decode("utf-8", "replace"), chunk, overlap, reach_of(model))
                        counts[k] = len(tokens)
            sizes = pa.array(map(len, raw), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sizes, pa.array(counts, pa.int64()), pa.array(chunks, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, RESULT)
