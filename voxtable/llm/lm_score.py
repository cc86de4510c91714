"""Language-model scores by a weighted backoff automaton over words and, below them, over the symbols that spell them.

The word state has an arc for each word w seen in training, of weight share * c(w) / N with N training tokens (the end of a text is a token), and a
failure arc of weight 1 - share to the spelling states. Spelling states are contexts of symbols: bytes of the words with A-Z lower-cased, a space
after each word, a line feed as the end. An n-gram hs of training is an arc of state h; where there is none, the failure arc leads to the state h'
without the first symbol, at mass / (c(h) + mass): P(s | h) = (c(hs) + mass * P(s | h')) / (c(h) + mass), and 1/256 below the empty context. Arc and
failure arc of a word add up, so that all probabilities sum to 1 over all texts. The traversal goes once over a text and carries its state on
across words.

Above the word state stand contexts of words: with ``word_order`` n, the n - 1 tokens before (at a text's start, its start). Their arcs and failure
arcs are weighted as those of the spelling states, P(w | h) = (c(hw) + word_mass * P(w | h')) / (c(h) + word_mass), down to the word state. N-grams of
words are compared by 63-bit hashes.

The corpus is never gathered in one place. Documents fall into blocks by a hash; a block counts its words and n-grams and deals them into buckets by
their hash; a bucket adds up the counts of all blocks, and each block gets back the sums of what occurs in it: the part of the automaton that its
texts can reach. A block and a bucket exchange one row, with a list of keys on the way there and sums in the same order on the way back, both compressed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import fold, stored

#: Symbols that an array step works on at once.
PART = 1 << 20


def symbols(words: list[bytes]) -> bytes:
    """The end of the text before, the words with a space after each, and the end."""
    return b"\n" + b" ".join([*words, b"\n"])


class Trie:
    """The distinct n-grams of a run of symbols, level by level.

    ``text`` holds documents one after the other; ``starts`` are the places of their first symbols, over which no n-gram reaches. ``each`` is called for
    each length with the n-gram that ends at each place, -1 where the document isn't that long yet.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, order: int, each: Callable[[np.ndarray], None] | None = None) -> None:
        self.alphabet = np.unique(text)
        code = np.zeros(256, np.int32)
        code[self.alphabet] = np.arange(len(self.alphabet), dtype=np.int32)
        self.code, self.width = code, len(self.alphabet)
        self.parent: list[np.ndarray] = []  # of each n-gram of a level: its first n-1 symbols, on the level below
        self.symbol: list[np.ndarray] = []  # and its last
        short = code.astype(np.uint8)
        place = np.zeros(len(text), np.int32)
        early = np.zeros(0, np.int64)  # places where the document isn't as long yet
        for n in range(order):
            if n:
                early = np.union1d(early, starts + n - 1)
                early = early[: np.searchsorted(early, len(text))]
            size = self.width * (len(self.parent[-1]) if n else 1)
            seen = np.zeros(size + 1, bool)  # the last stands for no n-gram
            for k in reversed(range(0, len(text), PART)):  # a part at a time, to spare memory; the last first, as it reads the place before
                part = place[k : k + PART]
                if n:
                    part[not k :] = place[max(k - 1, 0) : k + len(part) - 1]
                    part *= np.int32(self.width)
                    part += short[text[k : k + PART]]
                else:
                    part[:] = short[text[k : k + PART]]
                part[early[slice(*np.searchsorted(early, [k, k + PART]))] - k] = size
                seen[part] = True
            found = np.flatnonzero(seen[:-1])
            ids = np.cumsum(seen, dtype=np.int32) - 1
            ids[-1] = -1
            for k in range(0, len(text), PART):
                part = place[k : k + PART]
                part[:] = np.take(ids, part, mode="clip")
            self.parent.append((found // self.width).astype(np.int32))
            self.symbol.append((found % self.width).astype(np.int32))
            if each:
                each(place)

    def keys(self) -> list[np.ndarray]:
        """Of each level: the n-grams as numbers, n in the highest byte and the symbols below."""
        packed, out = np.zeros(1, np.int64), []
        for n, (parent, symbol) in enumerate(zip(self.parent, self.symbol), 1):
            packed = packed[parent] << 8 | self.alphabet[symbol].astype(np.int64)
            out.append(packed | np.int64(n) << 56)
        return out


def numbered(flat: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of symbols, the end first; the number of each token; and how many tokens each text has."""
    close = _at(starts, len(flat))  # the symbol before a text is read as a token too: the first one of all is an end
    for k in range(0, len(flat), PART):
        part = flat[k : k + PART]
        close[k : k + PART] |= (part == 32) | (part == 10)
    cuts = np.append(0, np.flatnonzero(close) + 1)
    every = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(flat)]).dictionary_encode()
    spelled, size = every.dictionary.buffers()[2], pa.compute.sum(pa.compute.binary_length(every.dictionary)).as_py()
    words = [b"", *spelled[1:size].to_pybytes().split()]  # each has a space after it, but for the first
    before = np.searchsorted(cuts, starts)
    return words, np.delete(every.indices.to_numpy(), before), np.diff(before, append=len(cuts) - 1) - 1


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def released(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, bytes of equal weight side by side and compressed, so that small ones take little."""
    return squeezed(np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(released(data), np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)


def mixed(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams made of a context and a token, from the hashes of both."""
    x = context ^ context >> np.uint64(32)  # one array, changed in place
    x *= np.uint64(0xD6E8FEB86659FD93)
    x += token
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


#: A random number for each place in a word and each byte there.
LONGEST = 32
PLACED = np.frombuffer(b"".join(blake2b(k.to_bytes(8, "little")).digest() for k in range((LONGEST + 1) * 256 // 8)), np.uint64)


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes: the sum of the numbers of a word's bytes and its end; of a long word, of those of its digest."""
    out = [np.zeros(0, np.uint64)]
    for k in range(0, len(words), 1 << 16):
        own = [w if len(w) <= LONGEST else blake2b(w, digest_size=LONGEST).digest() for w in words[k : k + (1 << 16)]]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
        starts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        out.append(np.add.reduceat(PLACED[place << 8 | np.frombuffer(b"\n".join([*own, b""]), np.uint8)], starts))
    return np.concatenate(out)


def word_grams(names: list[bytes], texts: list[list[bytes]], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``token_grams`` of texts given as words."""
    index, sizes = dict(zip(names, range(len(names)))), np.array([len(w) + 1 for w in texts], np.int64)
    tokens = np.fromiter(map(index.__getitem__, chain.from_iterable(chain(w, (b"",)) for w in texts)), np.int32, int(sizes.sum()))
    return token_grams(hashes(names), index[b""], tokens, sizes, order)


def token_grams(hashed: np.ndarray, end: int, tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each length from 2: the distinct n-grams of words (numbers below zero), and the place among them of that which ends at each token, or -1.

    ``hashed`` has the hash of each word, ``tokens`` the word of each token, ``sizes`` the tokens of each text, the last of which is the word ``end``.
    """
    first, token = np.cumsum(sizes) - sizes, hashed[tokens]
    gram, have, out = token, np.ones(len(token), bool), []
    for n in range(2, order + 1):
        gram = np.roll(gram, 1)
        if n == 2:
            gram[first] = hashed[end]
        else:
            have = np.roll(have, 1)
            have[first] = False
        gram = mixed(gram, token)
        own = gram[have]
        own |= np.uint64(1 << 63)
        own = own.view(np.int64)
        order_of = np.argsort(own).astype(np.int32)
        own = own[order_of]
        fresh = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
        place = np.full(len(token), -1, np.int32)
        place[np.flatnonzero(have).astype(np.int32)[order_of]] = np.cumsum(fresh, dtype=np.int32) - 1
        del order_of
        out.append((own[fresh], place))
        del own, fresh
    return out


@dataclass
class Counts:
    """What a block holds: words (the first is the end, the empty word) and n-grams, their counts in training texts, and those of n-grams as contexts.

    Texts are ``tokens``, the places of their words, ``sizes`` of them each, and their symbols, ``flat`` from ``starts`` on.
    N-grams of words come after those of symbols; ``levels`` has, for each length from 2, the place of that which ends at each token. As a context
    one has been followed as often as it came up, but for the end, which is none, so that ``contexts`` has those of symbols alone.

    Keys are in an order that only the set of texts decides, so that sums can come back without them.
    """

    words: list[bytes]
    word_counts: np.ndarray
    trie: Trie
    grams: np.ndarray
    gram_counts: np.ndarray
    contexts: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    levels: list[np.ndarray]
    tokens: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: Iterable[list[bytes]], trained: int, order: int, word_order: int = 1, counted: bool = True) -> Counts:
        """``texts``: the training texts first, ``trained`` in number. Each is read once, and kept as numbers and symbols alone. Unless ``counted``, n-grams are only found."""
        flat, starts = bytearray(), []
        for own in texts:
            starts.append(len(flat))
            flat += symbols(own)
        flat, starts = np.frombuffer(flat, np.uint8), np.array(starts, np.int64)
        names, tokens, sizes = numbered(flat, starts)
        learned = int(sizes[:trained].sum())
        words = np.bincount(tokens[:learned], minlength=len(names))
        end = int(starts[trained]) if trained < len(starts) else len(flat)
        first, last = starts[:trained], np.append(starts[1 : trained + 1], len(flat))[:trained] - 1
        counts, contexts = [], []

        def add(place: np.ndarray) -> None:
            n = int(place.max(initial=-1)) + 2
            total = sum((np.bincount(place[k : min(end, k + PART)] + 1, minlength=n) for k in range(0, end, PART)), np.zeros(n, np.int64))
            counts.append((total - np.bincount(place[first] + 1, minlength=n))[1:].astype(np.int32))  # the symbol before a text is not an event of it
            contexts.append((total - np.bincount(place[last] + 1, minlength=n))[1:])  # nor is its end the context of one

        trie = Trie(flat, starts, order, add if counted else None)
        grams, levels = trie.keys(), []
        for keys, place in token_grams(hashes(names), 0, tokens, sizes, word_order):
            if counted:
                total = (np.bincount(place[k : min(learned, k + PART)] + 1, minlength=len(keys) + 1).astype(np.int32) for k in range(0, learned, PART))
                counts.append(sum(total, np.zeros(len(keys) + 1, np.int32))[1:])
            place[place >= 0] += sum(map(len, grams))
            levels.append(place)
            grams.append(keys)
        grams, spelled = np.concatenate(grams), sum(map(len, trie.symbol))
        counts, contexts = (np.concatenate(x) if counted else np.zeros(n, np.int32) for x, n in ((counts, 0), (contexts, spelled)))
        return Counts(names, words, trie, grams, counts, contexts, flat, starts, levels, tokens, sizes)

    def spelled(self, places: np.ndarray) -> np.ndarray:
        """Those of the n-grams that are of symbols."""
        return places[places < len(self.contexts)]

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each word and of each n-gram. Those of words are hashes already: a bucket has a range of them, whose differences are small."""
        keys, spelled = self.grams.view(np.uint64), len(self.contexts)
        grams = np.empty(len(keys), np.int32)
        grams[:spelled] = (keys[:spelled] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)
        for k in range(spelled, len(keys), PART):
            grams[k : k + PART] = (keys[k : k + PART] << np.uint64(1) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        return np.fromiter(map(crc32, self.words), np.int64, len(self.words)) % n, grams


def grouped(bucket: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each bucket, in order."""
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=n))[:-1])


class Automaton:
    """The part of the model that a block can reach, with failure arcs followed beforehand: for a state and a symbol, the next state and the weight.

    States are the contexts of the block, from the empty one to those of order - 1 symbols; a context that training has not followed has the
    arcs of the state it fails to. ``counts`` and ``contexts`` are those of the trie's n-grams over the whole corpus, level by level.
    """

    def __init__(self, trie: Trie, counts: np.ndarray, contexts: np.ndarray, total: float, mass: float) -> None:
        width, place = trie.width, 0
        self.order, self.width, self.code = len(trie.symbol), width, trie.code
        sizes = [1, *map(len, trie.symbol[:-1])]  # contexts of 0 symbols, of 1, ...
        mass, follow, weight = np.float32(mass), np.empty((sum(sizes), width), np.int32), np.empty((sum(sizes), width), np.float32)
        arcs, suffix, start, before = np.array([total], float), np.zeros(1, np.int64), 0, 0
        for n, size in enumerate(sizes):  # contexts of n symbols; their n-grams are those of n + 1
            level = slice(place, place + len(trie.symbol[n]))
            place = level.stop
            own, parent, symbol = slice(start, start + size), trie.parent[n], trie.symbol[n]
            if n:
                np.take(weight[before:start], suffix, axis=0, out=weight[own], mode="clip")
                np.take(follow[before:start], suffix, axis=0, out=follow[own], mode="clip")
            else:
                weight[own], follow[own] = 1 / 256, 0
            weight[own] *= mass
            weight[own][parent, symbol] += counts[level].astype(np.float32)
            weight[own] /= (arcs[:, None] + mass).astype(np.float32)
            if n < self.order - 1:  # the contexts of n + 1 symbols: what each fails to, and how often it was followed
                suffix, arcs = (follow[own][parent, symbol] - start if n else np.zeros(len(symbol), np.int32)), contexts[level]
                follow[own][parent, symbol] = own.stop + np.arange(len(symbol), dtype=np.int32)
            before, start = start, own.stop
        np.log10(weight, out=weight)
        self.next, self.weight = follow.ravel(), weight.ravel()

    def walk(self, flat: np.ndarray, starts: np.ndarray, piece: int = 1024) -> np.ndarray:
        """The weight of each symbol: one pass from left to right carries every text's state.

        All texts step together. Long ones are cut; a cut starts order - 1 symbols earlier, after which its state is the true one.
        """
        sym, ends, warm = self.code.astype(np.uint8)[flat], np.append(starts[1:], len(flat)), self.order - 1
        cuts = [np.arange(s + 1, e, piece) for s, e in zip(starts, ends)]
        first = np.concatenate(cuts)
        stop = np.concatenate([np.append(c[1:], e) for c, e in zip(cuts, ends)])
        begin = np.maximum(first - warm, np.repeat(starts, [len(c) for c in cuts]))
        order = np.argsort(begin - stop, kind="stable")
        first, begin, length = first[order], begin[order], (stop - begin)[order]
        state, out, active = np.zeros(len(order), np.int32), np.zeros(len(flat), np.float32), len(order)
        for t in range(int(length[0]) if active else 0):
            while length[active - 1] <= t:
                active -= 1
            at = begin[:active] + t
            arc = state[:active] * np.int32(self.width) + sym[at]
            if t < warm:
                own = at >= first[:active]
                out[at[own]] = self.weight[arc[own]]
            else:
                out[at] = np.take(self.weight, arc, mode="clip")
            state[:active] = np.take(self.next, arc, mode="clip")
        return out


def token_scores(own: Counts, word_counts: np.ndarray, automaton: Automaton, tokens: int, share: float, gram_counts: np.ndarray, word_mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: known tokens, the sum of log10(c + 0.1), and the log10 probability. Worked out for runs of texts of about ``PART`` symbols."""
    ends, token, out = np.append(own.starts[1:], len(own.flat)), 0, []
    runs = np.flatnonzero(np.diff(ends // PART, prepend=-1, append=ends[-1:] // PART + 1)).tolist()  # a run ends before a text that ends in another part
    for one, two in zip(runs[:-1], runs[1:]):
        length = own.sizes[one:two]
        flat, starts = own.flat[own.starts[one] : ends[two - 1]], own.starts[one:two] - own.starts[one]
        counts = word_counts[own.tokens[token : token + int(length.sum())]]
        close = (flat == 32) | (flat == 10)  # ends of tokens; the symbol before a text is the end of none, but a token begins after it
        begins = np.flatnonzero(close[:-1] & ~_at(starts, len(flat))[1:]) + 1
        spelled = np.add.reduceat(automaton.walk(flat, starts), begins, dtype=np.float64)
        with np.errstate(divide="ignore"):
            by_word = np.log(share * counts / tokens) if tokens else np.full(len(counts), -np.inf)
            worded = np.logaddexp(by_word, math.log(1 - share if tokens else 1.0) + spelled * math.log(10))
        first = np.cumsum(length) - length
        times, start = counts, word_counts[0]
        for level in own.levels:
            place = level[token : token + len(counts)]
            followed = np.roll(times, 1)
            followed[first] = start
            times, start = np.where(place >= 0, gram_counts[place], 0), 0
            with np.errstate(divide="ignore"):
                longer = np.logaddexp(np.log(times), math.log(word_mass) + worded) - np.log(followed + word_mass)
            worded = np.where(place >= 0, longer, worded)
        worded = worded / math.log(10)
        out.append((np.add.reduceat(counts > 0, first, dtype=np.int64), np.add.reduceat(np.log10(counts + 0.1), first), np.add.reduceat(worded, first)))
        token += len(counts)
    return tuple(map(np.concatenate, zip(*out)))


def in_order(table: pa.Table) -> tuple[pa.Table, Iterator[list[bytes]], int]:
    """The rows of a block in an order of their own, training texts first, without the texts; their words; and the number of training texts."""
    rows = table.sort_by([("held_out", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    texts = (released(x).lower().split() if x else [] for batch in rows.column("text").chunks for x in batch.to_pylist())
    return rows.drop_columns("text"), texts, rows.num_rows - sum(rows.column("held_out").to_pylist())


def squeezed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (x if x is None else squeezed(x) for x in batch.column("text").cast(pa.binary()).to_pylist())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def _at(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places] = True
    return out


COUNTED = "block bigint, bucket bigint, words binary, word_counts binary, grams binary, gram_counts binary, contexts binary"
SUMMED = "block bigint, bucket bigint, word_counts binary, gram_counts binary, contexts binary, tokens bigint, distinct bigint, total bigint"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_part double, score double"


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, test: int = 0, order: int = 5, mass: float = 4.0, share: float = 0.25, block_bytes: int = 12 << 20, word_order: int = 1, word_mass: float = 4.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows outside the test fold. Tokens are the words (A-Z lower-cased) and one end. base_score adds up log10((c + 0.1) / (N + 0.1 (V + 1))),
    score is the automaton's log10 probability of the text. Null texts are empty: the end alone. Rows with null ids are
    learned from; repeated rows are counted and scored each; other columns are not read; an empty table gives no rows.
    Blocks hold about ``block_bytes`` of text (or one text), whatever the size of the corpus, and there are as many buckets, of about as many keys.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = 1 + size // block_bytes
    spark = docs.sparkSession
    where = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(n_blocks))
    blocked = docs.select(where.alias("block"), F.col(doc_id).cast("bigint").alias("doc_id"), (fold(doc_id, folds) == test).alias("held_out"), F.col(text).alias("text"))
    blocked = blocked.mapInArrow(squeezed_texts, "block bigint, doc_id bigint, held_out boolean, text binary")

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, texts, trained = in_order(table)
        own = Counts.of(texts, trained, order, word_order)
        rows = []
        for k, (w, g) in enumerate(zip(*(grouped(x, n_blocks) for x in own.buckets(n_blocks)))):
            if len(w) or len(g):
                # n-grams ascend but for a few places, so that their differences are shorter than they are
                rows.append((k, squeezed(b"\n".join([own.words[i] for i in w])), packed(own.word_counts[w]), packed(np.diff(own.grams[g], prepend=0)), packed(own.gram_counts[g]), packed(own.contexts[own.spelled(g)])))
        del own
        columns = [pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))]
        return pa.table(columns, ["block", "bucket", "words", "word_counts", "grams", "gram_counts", "contexts"])

    def add_up(table: pa.Table) -> pa.Table:
        numbers = lambda name: [unpacked(x) for x in table.column(name).to_pylist()]
        counts = numbers("word_counts")
        words = [released(x).split(b"\n") if len(n) else [] for x, n in zip(table.column("words").to_pylist(), counts)]
        sums: dict[bytes, int] = {}
        for keys, values in zip(words, counts):
            for w, n in zip(keys, values.tolist()):
                sums[w] = sums.get(w, 0) + n
        grams = [np.cumsum(x) for x in numbers("grams")]
        cuts = np.cumsum([len(x) for x in grams])[:-1]
        keys, which = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]), return_inverse=True)
        del grams
        spread, both = [], []
        for name in ("gram_counts", "contexts"):
            total = np.bincount(which, np.concatenate([np.zeros(0), *numbers(name)]), len(keys)).astype(np.int64)
            spread.append([packed(total[x]) for x in np.split(which, cuts)])
            both.append(total)
            own = keys[which] >= 0  # contexts are those of n-grams of symbols
            cuts, which = np.cumsum([x.sum() for x in np.split(own, cuts)])[:-1], which[own]
        once = np.zeros((3, table.num_rows), np.int64)  # what holds for the bucket stands in one of its rows
        once[:, 0] = sum(sums.values()), sum(n > 0 for n in sums.values()), both[0][(keys >> 56) == 1].sum()
        columns = [table.column("block"), table.column("bucket"), pa.array([packed(np.fromiter(map(sums.__getitem__, w), np.int64, len(w))) for w in words], pa.binary()), *(pa.array(x, pa.binary()) for x in spread), *(pa.array(x) for x in once)]
        return pa.table(columns, ["block", "bucket", "word_counts", "gram_counts", "contexts", "tokens", "distinct", "total"])

    model = stored(blocked.groupBy("block").applyInArrow(count, COUNTED).groupBy("bucket").applyInArrow(add_up, SUMMED))
    tokens, distinct, total = (x or 0 for x in model.agg(F.sum("tokens"), F.sum("distinct"), F.sum("total")).first())

    def score(key, rows: pa.Table, sums: pa.Table) -> pa.Table:
        rows, texts, trained = in_order(rows)
        own = Counts.of(texts, trained, order, word_order, counted=False)  # the counts of the corpus take their place
        places = dict(enumerate(zip(*(grouped(x, n_blocks) for x in own.buckets(n_blocks)))))
        word_counts, gram_counts, contexts = (np.zeros(n, np.int64) for n in (len(own.words), len(own.grams), len(own.contexts)))
        own.grams = None
        for batch in sums.select(["bucket", "word_counts", "gram_counts", "contexts"]).to_batches(max_chunksize=1):
            bucket, *parts = (x[0].as_py() for x in batch.columns)
            w, g = places.pop(bucket)
            for to, at, part in zip((word_counts, gram_counts, contexts), (w, g, own.spelled(g)), parts):
                to[at] = unpacked(part)
        del places, sums, batch, parts
        automaton = Automaton(own.trie, gram_counts, contexts, total, mass)
        own.trie = own.contexts = contexts = None
        found = token_scores(own, word_counts, automaton, tokens, share, gram_counts, word_mass)
        columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(own.sizes), *map(pa.array, found)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_part", "score"])

    found = blocked.groupBy("block").cogroup(model.drop("tokens", "distinct", "total").groupBy("block")).applyInArrow(score, SCORED)
    each = math.log10(tokens + 0.1 * (distinct + 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base_part") - F.col("n_tokens") * each).alias("base_score"), "score")
