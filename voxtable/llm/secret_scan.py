"""Secret scans: a trigram inverted index over the texts answers Boolean queries derived from the rules' expressions; candidates are verified."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import free


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # what Java and Python read alike
    least: int  # characters of the group, at least
    group: int = 0


#: What follows the first line of a private key: all up to its END line. Where there is none before the next five dashes (or within 200 runs of dashes), the
#: headers of an encrypted key and all that can stand in a body: base64, white space, quotes, the marks of quoted lines and of escaped line feeds.
KEY_BODY = (
    r"(?:[^-]*(?:-{1,4}[^-]+){0,200}-{5,}END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[\x20\t\r\n\\nr]*(?:Proc-Type|DEK-Info):[^\n\\]*){0,2}[A-Za-z0-9+/=\x20\t\r\n\\\x22'>]*)"
)
#: The three base rules, then those that the method adds.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("temporary", r"ASIA[A-Z0-9]{12,}", 16),
    Rule("forge", r"gh[opusr]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}", 24),
    Rule("map", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 24),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_BODY, 27),
]

#: A query: all clauses must hold; a clause holds if one of its sets of trigrams is in the text as a whole. No clause: no mandatory trigram.
Query = list[list[frozenset[str]]]


def trigram_query(regex: str, most: int = 16) -> Query:
    """The trigrams that any match of the expression must contain, lower-cased.

    Walks the parsed expression with the set of strings that can stand so far (at most ``most``); where that set can't be continued exactly,
    it becomes a clause and starts anew. A clause in which some string is shorter than three characters says nothing and is left out.
    """
    query: Query = []

    def flush(strings: set[str]) -> set[str]:
        sets = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
        if sets and all(sets):
            query.append(sorted(set(sets), key=sorted))
        return {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, if they are few."""
        out = {""}
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                more = {chr(value).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
                more = {chr(v).lower() for _, v in value}
            elif name == "SUBPATTERN":
                more = exact(value[3])
            elif name == "BRANCH":
                parts = [exact(b) for b in value[1]]
                more = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and value[1] == value[0] + (value[0] == 0) and value[0] < 8:
                once = exact(value[2])
                more = once if once is None else ({""} | once if value[0] == 0 else {"".join(x) for x in _times(once, value[0])})
            else:
                more = None
            if more is None or len(out) * len(more) > most:
                return None
            out = {a + b for a in out for b in more}
        return out

    current = {""}
    for item in parser.parse(regex):
        more = exact([item])
        if more is not None and len(current) * len(more) <= most:
            current = {a + b for a in current for b in more}
            continue
        current = flush(current)
        if more is not None:
            current = more
        elif str(item[0]) == "MAX_REPEAT" and item[1][0] > 0:
            flush(exact(item[1][2]) or {""})
    flush(current)
    return query


def _times(strings: set[str], n: int) -> list[tuple[str, ...]]:
    return reduce(lambda rows, _: [(*r, s) for r in rows for s in strings], range(n), [()])


def row_key(doc_id: str, text: str) -> Column:
    """Rows alike in id and text share a key; two others with the same hash only become candidates together."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def trigram_index(docs: DataFrame, text: str, key: Column, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key): the rows whose lower-cased text has the trigram; only trigrams that some query asks for are indexed."""
    lowered = docs.select(key.alias("key"), F.lower(F.col(text)).alias("low"))
    return lowered.select("key", "low", F.explode(F.array(*map(F.lit, trigrams))).alias("trigram")).where(F.contains("low", "trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key and ``rules``, the names of the rules whose query holds there: each row's postings meet and are intersected with the query's."""
    found = index.groupBy("key").agg(F.collect_set("trigram").alias("found"))
    held = lambda part: F.size(F.array_intersect("found", F.array(*map(F.lit, sorted(part))))) == len(part)
    clause = lambda c: reduce(lambda a, b: a | b, map(held, c))
    rules = [F.when(reduce(lambda a, b: a & b, map(clause, q)), F.lit(name)) for name, q in queries.items() if q]
    return found.select("key", F.filter(F.array(*rules), lambda x: x.isNotNull()).alias("rules")).where(F.size("rules") > 0)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points. What ``split`` leaves between matches gives their places."""
    every, group = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    rows = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"), every.alias("match"), group.alias("group"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(b.alias("at"), F.when(F.length(x["group"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.exists(group, lambda g: F.length(g) >= rule.least), F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(SPAN))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> tuple[DataFrame, str]:
    """All rows and columns, with one more column (its name is returned) of the spans of all rules, by start and then in the order of the rules.

    Spans count code points, with the end exclusive. Null and empty texts have none. Null ids, repeated rows, other columns of any name and empty
    tables are carried through.
    """
    rules = rules or RULES
    names = free(docs, "secret_key_", "secret_rules_", "secret_spans_")
    key, found, out = names
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    trigrams = sorted({t for q in queries.values() for clause in q for part in clause for t in part})
    keyed = docs.withColumn(key, row_key(doc_id, text))
    if trigrams:
        hits = candidates(trigram_index(docs, text, row_key(doc_id, text), trigrams), queries)
        keyed = keyed.join(hits.select(F.col("key").alias(key), F.col("rules").alias(found)), key, "left")
    else:
        keyed = keyed.withColumn(found, F.lit(None).cast("array<string>"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    each = [
        F.when(F.array_contains(found, r.kind), rule_spans(whole, r, k)).otherwise(F.array().cast(SPAN)) if queries[r.kind] else rule_spans(whole, r, k)
        for k, r in enumerate(rules)
    ]
    return keyed.select(*(F.col(f"`{c}`") for c in docs.columns), F.sort_array(F.concat(*each)).alias(out)), out


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row, as ``secret_spans`` finds them; very long texts are scanned whole."""
    found, spans = secret_spans(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col(spans)).alias("spans"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with each stretch of characters that spans cover replaced by one mark; a text without spans stays, null as well."""
    found, spans = secret_spans(docs, doc_id, text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = (s["start"] < acc["at"]) & (acc["at"] > 0)
        more = F.concat(acc["out"], F.substring(f"`{text}`", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(inside, acc["out"]).otherwise(more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step)
    clean = F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(f"`{text}`", done["at"] + 1, F.length(f"`{text}`")))).otherwise(F.col(f"`{text}`"))
    return found.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
