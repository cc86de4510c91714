from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from voxtable.llm import chat_transcript, language_id, line_quality, lm_score

FOLD = lambda i, n: zlib.crc32(str(i).encode()) % n if i is not None else -1


@pytest.mark.parametrize("block", [2_000, 12 << 20])
def test_language_model_by_brute_force(odd, odd_rows, block):
    rows = [(i, t or "") for i, t, *_ in odd_rows]
    words, grams, contexts = Counter(), Counter(), Counter()
    for i, text in rows:
        if FOLD(i, 10) != 0:
            own = text.encode().lower().split()
            words.update([*own, b"\n"])
            s = lm_score.symbols(own)
            for p in range(1, len(s)):
                for n in range(min(4, p + 1)):
                    grams[s[p - n : p + 1]] += 1
                    contexts[s[p - n : p]] += 1
    tokens, distinct = sum(words.values()), len(words)

    def probability(h: bytes, s: bytes) -> float:
        lower = probability(h[1:], s) if h else 1 / 256
        return (grams[h + s] + 4 * lower) / (contexts[h] + 4)

    want = []
    for i, text in rows:
        own = text.encode().lower().split()
        s, p, score = lm_score.symbols(own), 1, 0.0
        for w in [*own, b"\n"]:
            spelled = 0.0
            for _ in range(len(w) + (w != b"\n")):
                spelled += math.log10(probability(s[max(0, p - 3) : p], s[p : p + 1]))
                p += 1
            score += math.log10(0.25 * words[w] / tokens + 0.75 * 10**spelled) if spelled > -300 else math.log10(0.75) + spelled
        base = sum(math.log10((words[w] + 0.1) / (tokens + 0.1 * (distinct + 1))) for w in [*own, b"\n"])
        want.append((i or -1, FOLD(i, 10) == 0, len(own) + 1, sum(words[w] > 0 for w in [*own, b"\n"]), tokens, base, score))
    got = [(r.doc_id or -1, *tuple(r)[1:]) for r in lm_score.scores(odd, order=4, block_bytes=block).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6) and a[6] == pytest.approx(b[6], rel=1e-4)


@pytest.mark.parametrize("block", [2_000, 12 << 20])
def test_word_contexts_by_brute_force(odd, odd_rows, block):
    rows = [(i, (t or "").encode().lower().split()) for i, t, *_ in odd_rows]
    spelling, spelled_after, grams, contexts = Counter(), Counter(), Counter(), Counter()
    for i, own in rows:
        if FOLD(i, 10) != 0:
            for s, most, many, after in ((lm_score.symbols(own), 3, spelling, spelled_after), ((b"", *own, b""), 2, grams, contexts)):
                for p in range(1, len(s)):
                    for n in range(min(most + 1, p + 1)):
                        many[s[p - n : p + 1]] += 1
                        after[s[p - n : p]] += 1

    def probability(h: bytes, s: bytes) -> float:
        lower = probability(h[1:], s) if h else 1 / 256
        return (spelling[h + s] + 4 * lower) / (spelled_after[h] + 4)

    want = []
    for i, own in rows:
        if max(map(len, own), default=0) < 100:
            s, tokens, p, score = lm_score.symbols(own), (b"", *own, b""), 1, 0.0
            for k, w in enumerate(tokens[1:], 1):
                spelled = 1.0
                for _ in range(len(w) + 1):
                    spelled *= probability(s[max(0, p - 3) : p], s[p : p + 1])
                    p += 1
                    if w == b"":
                        break
                found = 0.25 * grams[(w,)] / contexts[()] + 0.75 * spelled
                for n in range(1, min(2, k) + 1):
                    found = (grams[tokens[k - n : k + 1]] + 6 * found) / (contexts[tokens[k - n : k]] + 6)
                score += math.log10(found)
            want.append((i or -1, len(own) + 1, score))
    got = [(r.doc_id or -1, r.n_tokens, r.score) for r in lm_score.scores(odd, order=4, block_bytes=block, word_order=3, word_mass=6.0).collect()]
    got = [x for x in got if x[0] not in {i for i, own in rows if max(map(len, own), default=0) >= 100}]
    assert len(got) == len(want) > 300
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4)


def test_a_known_phrase_beats_its_words_in_other_orders(spark):
    phrase = "kalo miru tesa vondi rapu selo".split()
    orders = {1000: phrase, 1001: phrase[::-1], 1002: phrase[::2] + phrase[1::2]}
    rows = [(k, " ".join(phrase * 3)) for k in range(200)] + [(k, " ".join(x)) for k, x in orders.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm_score.scores(docs, word_order=3, block_bytes=500).collect()}
    assert got[1000] > got[1001] + 4 and got[1000] > got[1002] + 4
    words, texts = [b"a", b"b", b"cc", b""], [[b"a", b"b"], [b"a", b"b", b"cc"], [b"a"]]
    two, three = (place.tolist() for _, place in lm_score.word_grams(words, texts, 3))
    assert two[0] == two[3] == two[7] and two[1] == two[4] and len(set(two)) == 6
    assert [three[k] for k in (0, 3, 7)] == [-1] * 3 and three[1] == three[4] and len(set(three)) == 6


def test_what_a_block_sends_is_short_and_its_automaton_takes_two_arrays():
    rng = np.random.default_rng(3)
    names = [bytes(rng.integers(97, 123, n, np.uint8)) for n in rng.integers(2, 9, 4000)]
    texts = [[names[k] for k in rng.zipf(1.3, 200) % 4000] for _ in range(300)]
    own = lm_score.Counts.of(texts, 300, 5, 3)
    parts = lm_score.grouped(own.buckets(4)[1], 4)
    for x in (np.diff(own.grams[parts[0]], prepend=0), own.gram_counts, own.contexts, np.zeros(0, np.int64)):
        assert lm_score.unpacked(lm_score.packed(x)).tolist() == x.tolist()
    assert np.cumsum(np.diff(own.grams, prepend=0)).tolist() == own.grams.tolist()
    assert max(map(len, parts)) < 1.2 * min(map(len, parts))
    sent = sum(len(lm_score.packed(x)) for g in parts for x in (np.diff(own.grams[g], prepend=0), own.gram_counts[g]))
    assert sent < 0.5 * (own.grams.nbytes + own.gram_counts.nbytes)
    tracemalloc.start()
    automaton = lm_score.Automaton(own.trie, own.gram_counts, own.contexts, 1.0, 4.0)
    assert tracemalloc.get_traced_memory()[1] < 1.6 * (automaton.next.nbytes + automaton.weight.nbytes)
    tracemalloc.stop()


def test_a_block_is_counted_and_scored_in_little_memory():
    rng = np.random.default_rng(5)
    names = np.array([bytes(rng.integers(97, 123, n, np.uint8)) for n in rng.integers(3, 9, 20_000)], object)
    texts = [names[rng.integers(0, 20_000, 400)].tolist() for _ in range(1200)]
    size = sum(len(lm_score.symbols(w)) for w in texts)
    tracemalloc.start()
    own = lm_score.Counts.of(iter(texts), 1100, 5, 3)
    tracemalloc.reset_peak()
    counts = own.gram_counts.astype(np.int64)
    automaton = lm_score.Automaton(own.trie, counts, own.contexts, 1.0, 4.0)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    known, base, score = lm_score.token_scores(own, own.word_counts, automaton, int(own.word_counts.sum()), 0.25, counts, 64.0)
    assert tracemalloc.get_traced_memory()[1] - held < 11 * size  # 8.1; 14.7 with all texts at once
    tracemalloc.stop()
    assert own.words[0] == b"" and own.gram_counts.itemsize == 4 and len(known) == len(base) == len(score) == 1200
    assert [own.words[k] for k in own.tokens] == [w for t in texts for w in (*t, b"")] and own.sizes.tolist() == [401] * 1200
    one = lm_score.Counts.of(texts, 1100, 5, 3, counted=False)
    assert (one.grams == own.grams).all() and (one.tokens == own.tokens).all() and len(one.contexts) == len(own.contexts)


def test_words_have_hashes_of_their_own():
    words = [b"", b"a", b"b", b"ab", b"ba", b"aab", b"a" * 32, b"a" * 33, b"a" * 34, bytes(33), *(b"w%d" % k for k in range(70_000))]
    got = lm_score.hashes(words)
    assert len(set(got.tolist())) == len(words) and got[3] == lm_score.hashes([b"ab"])[0]


def test_language_model_without_rows_or_training(odd):
    assert lm_score.scores(odd.limit(0)).count() == 0
    only = lm_score.scores(odd.where("doc_id = 30"), folds=1).first()
    assert only.held_out and only.train_tokens == 0 and only.n_known == 0 and math.isfinite(only.score) and only.base_score == pytest.approx(0)


def test_languages(odd, odd_rows):
    got = [r.asDict() for r in language_id.identify(odd).collect()]
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (1, 2, 3, 4))
    prose = [(i, lang) for i, _, lang, _ in odd_rows if i and 30 <= i < 330]
    assert all(by_id[i]["lang_pred"] == lang and not by_id[i]["rejected"] for i, lang in prose)
    assert all(r["held_out"] == (FOLD(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    left = language_id.kept(odd)
    assert left.columns == odd.columns and left.where("doc_id between 30 and 329").count() == 300 and left.where("doc_id < 5").count() == 0
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.where("lang is null")).collect()} == {"und"}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    counts, change = np.array([3, 0, 1, 4]), rng.normal(size=(2, 2))
    score = rng.normal(size=8)
    p, uses, log_z = line_quality.marginals(score, change, counts)
    start, want, all_uses, all_z = 0, [], np.zeros((2, 2)), 0.0
    for n in counts:
        own, z, good, u = score[start : start + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in product((0, 1), repeat=int(n)):
            w = math.exp(sum(own[k] * y for k, y in enumerate(labels)) + sum(change[a, b] for a, b in zip(labels, labels[1:])))
            z += w
            good += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                u[a, b] += w
        want += list(good / z)
        all_uses += u / z
        all_z += math.log(z)
        start += n
    assert p == pytest.approx(want) and uses == pytest.approx(all_uses) and log_z == pytest.approx(all_z)


def test_line_quality(spark, odd):
    labels = [(i, int(i % 7 != 0), 1) for i in range(1000, 1300)] + [(None, 1, 1), (1000, None, 1), (5, 3, 1)]
    good = "The words of a plain line follow each other here.\nAnother one comes after it, and then no more.\n"
    rows = [(i, good * (i % 3 + 1) if q else "BUY!! NOW!! $$$ ### " * (i % 9 + 1), None) for i, q, _ in labels[:300]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, text int")
    got = line_quality.quality_scores(docs, table).collect()
    assert all((r.score >= 0.3) == (r.predicted == 1) == (r.doc_id % 7 != 0) and r.held_out == (FOLD(r.doc_id, 5) == 0) for r in got)
    rest = line_quality.quality_scores(odd, table).collect()
    assert len(rest) == odd.count() and all(0 <= r.score <= 1 for r in rest)
    assert line_quality.quality_scores(odd.limit(0), table).count() == 0
    assert {r.score for r in line_quality.quality_scores(odd, table.limit(0)).collect()} == {0.5}


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(4)
    draw = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = chat_transcript.Model(draw(6), draw(6, 6), draw(6, chat_transcript.N_SYMBOLS))
    symbols = rng.integers(0, chat_transcript.N_SYMBOLS, 5).tolist()
    value = lambda path: model.first[path[0]] + sum(model.emit[s, o] for s, o in zip(path, symbols)) + sum(model.change[a, b] for a, b in zip(path, path[1:]))
    assert model.viterbi(symbols) == list(max(product(range(6), repeat=5), key=value))


def test_chat_formatting(spark):
    rows = []
    for c in range(300):
        if c % 4 == 0:
            rows.append((c, 0, "system", "Answer in a few words and keep to the facts."))
        for k in range(c % 3 + 1):
            rows += [(c, 2 * k + 1, "user", f"What is {c} and {k}?"), (c, 2 * k + 2, "assistant", "It is a long answer that has many words in it.\n" * 3 + "That is all of the answer, with a last long line of text.")]
    rows += [(None, None, None, None), (None, 1, "user", "Who?"), (900, 0, "narrator", "unknown role"), (901, 3, "user", ""), (901, 3, "user", ""), (902, 500, "user", "Far away?")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, rendered string")
    got = chat_transcript.chat_formatting(table).collect()
    known = [r for r in got if r.n_right is not None and r.held_out]
    assert sum(r.n_right for r in known) >= 0.9 * sum(r.n_lines for r in known) > 0
    assert {r.conv_id for r in got} == {r[0] for r in rows} and {r.segment for r in got if r.conv_id == 902} == {7}
    assert all(r.rendered.count("<|end|>") == r.n_turns == len(r.roles.split(",")) for r in got)
    assert chat_transcript.chat_formatting(table.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[1, 1, 1], [3, 1, 4, 2], [7]])
def test_borders_are_those_of_the_whole(sizes):
    rng = np.random.default_rng(7)
    draw = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    for _ in range(50):
        model = chat_transcript.Model(draw(6), draw(6, 6), draw(6, chat_transcript.N_SYMBOLS))
        parts = [rng.integers(0, chat_transcript.N_SYMBOLS, n).tolist() for n in sizes]
        ends = chat_transcript.borders([model.across(x) for x in parts])
        path = [s for x, a, b in zip(parts, [None, *ends], ends) for s in model.viterbi(x, a, b)]
        assert path == model.viterbi([s for x in parts for s in x])


def test_a_long_conversation_is_decoded_as_one(spark):
    rows = [(c, k, ("user", "assistant")[k % 2], f"Is it {k}?" if k % 2 == 0 else "It is so.\n" * (k % 3) + f"That is {k}.") for c in range(4) for k in range(40)]
    rows += [(7, k // 3 if k < 60 else None if k < 120 else 50, ("user", "assistant", "system")[k % 3], f"turn {k % 17} of it\nand more" + "?" * (k % 2)) for k in range(300)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    one = {r.conv_id: r for r in chat_transcript.as_transcripts(table, segment=1000).collect()}
    written = chat_transcript.as_transcripts(table, segment=16).cache()
    parts = {c: sorted((r for r in written.collect() if r.conv_id == c), key=lambda r: (r.segment, r.part)) for c in one}
    assert max(r.true_turns for own in parts.values() for r in own) <= 16 and {len(own) for own in parts.values()} == {3, 7 + 1 + 12}
    for c, own in parts.items():
        assert "\n".join(r.transcript for r in own) == one[c].transcript and [s for r in own for s in r.states] == one[c].states
        assert [r.before for r in own] == [-1, *(r.states[-1] for r in own[:-1])] and {r.n_parts for r in own} == {len(own)}
    model, same = (chat_transcript.fit(x, "transcript", "states", before="before") for x in (written, chat_transcript.as_transcripts(table, segment=1000)))
    assert (model.first == same.first).all() and (model.change == same.change).all() and (model.emit == same.emit).all()
    found = {r.key: r for r in chat_transcript.parse(written.join(chat_transcript.border_states(written, model), "key"), model, "key", "transcript", "entry", "last").collect()}
    for c, own in parts.items():
        turns: list = []
        for r in own:
            got = found[r.key]
            pieces = list(zip(got.roles.split(","), [x.split("|>\n", 1)[1] for x in got.rendered.split("\n<|end|>\n")[:-1]]))
            if got.goes_on:
                assert pieces[0][0] == turns[-1][0]
                turns[-1] = (turns[-1][0], turns[-1][1] + "\n" + pieces.pop(0)[1])
            turns += pieces
        assert chat_transcript.rendered(turns) == chat_transcript.rendered(chat_transcript.turns_of(model, one[c].transcript))


def test_unknown_roles_teach_nothing(spark):
    rows = [(900, 0, "narrator", "unknown role"), (900, 1, "user", "hello"), (901, 0, "user", "hello"), (901, 1, "tool", None), (902, 1, None, "no role"), (903, 1, "assistant", "fine")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    written = chat_transcript.as_transcripts(table).cache()
    assert {r.conv_id: r.states for r in written.collect()} == {900: None, 901: None, 902: None, 903: [4]}
    both, alone = (chat_transcript.fit(x, "transcript", "states") for x in (written, written.where("conv_id = 903")))
    assert (both.first == alone.first).all() and (both.change == alone.change).all() and (both.emit == alone.emit).all()
    assert {r.conv_id: r.n_right is None for r in chat_transcript.chat_formatting(table).collect()} == {900: True, 901: True, 902: True, 903: False}


def test_transcripts_written_by_others():
    base = chat_transcript.N_SYMBOLS // 4
    emit = np.full((6, chat_transcript.N_SYMBOLS), math.log(1e-3))
    for role in range(3):
        emit[2 * role, role * base : (role + 1) * base] = math.log(0.05)
        emit[2 * role + 1, 3 * base :] = math.log(0.05)
    change = np.full((6, 6), math.log(1 / 12))
    for role in range(3):
        change[2 * role, 2 * role + 1] = change[2 * role + 1, 2 * role + 1] = math.log(1 / 2)
    model = chat_transcript.Model(np.full(6, math.log(1 / 6)), change, emit)
    text = "SYSTEM: be brief\nHuman: hello there\nand more\n**AI**: fine\n\nQ: next?"
    assert chat_transcript.turns_of(model, text) == [("system", "be brief"), ("user", "hello there\nand more"), ("assistant", "fine\n"), ("user", "next?")]
    assert chat_transcript.rendered([("user", " a \n")]) == "<|user|>\na\n<|end|>\n"


def test_numerals_are_no_letters_and_many_languages_are_learned(spark):
    texts = {"½ ② Ⅷ 12": "und", "½ x": None, "": "und", "_ 7": "und", "ª": None}
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(100 + k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} " * 20, f"l{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    few = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, most_langs=10).collect()}
    assert few == {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    for k, want in enumerate(texts.values()):
        assert (few[k][0] == "und") == (want == "und")
    learned = [k for k in range(60) if few[100 + k][0] == f"l{k}"]
    assert len(learned) >= 35  # three of four are learned from
