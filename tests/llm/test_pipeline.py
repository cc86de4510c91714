from __future__ import annotations

import hashlib
import re

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import library
from voxtable.llm import decontaminate, language_id, secret_scan


def test_pipeline_by_brute_force(spark, odd, odd_rows, items, odd_items, tmp_path):
    odd.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    items.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.model_of(docs, "doc_id", "text", "lang", 4, 2, 4096, 400, 4, 400).value
    rows = [r for r in odd_rows if r[1] is not None and not model.predict(r[1].encode())[2]]
    first = {}
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = next(c for i, _, c, _ in brute([r[:2] for r in rows]) if i == row[0])
        if found == row[0]:
            first.setdefault(row[0], row)
    rows = list(first.values()) + [r for r in rows if r[0] is None]
    windows = [w for _, text in odd_items if text for words in [decontaminate.words_of(text.encode())] if words for n in [min(10, len(words))] for k in range(len(words) - n + 1) for w in [b" " + b" ".join(words[k : k + n]) + b" "]]
    rows = [r for r in rows if not any(w in b" " + b" ".join(decontaminate.words_of(r[1].encode())) + b" " for w in windows)]
    want = []
    for i, text, *_ in rows:
        marked = [False] * len(text)
        for rule in secret_scan.RULES:
            for m in re.finditer(rule.regex, text):
                if len(m[rule.group]) >= rule.least:
                    marked[m.start() : m.end()] = [True] * (m.end() - m.start())
        clean = re.sub("\x00+", "[SECRET]", "".join("\x00" if x else c for c, x in zip(text, marked)))
        ids, decoded = library(clean)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 250


def test_stages_keep_the_columns(spark, odd, items, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
