"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query. Postings (trigram, document) are built for the
trigrams that the rules ask for; intersecting them gives candidate documents, which the expression then
verifies. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LIMIT = 64


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; ``base`` rules come first, in the order listed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base patterns of the query's contract, then public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets (each set itself an AND), lower-case; an empty list when nothing is mandatory.

    Runs of the expression that stand for few strings are enumerated, others end a run, after the idea of
    Cox, "Regular Expression Matching with a Trigram Index" (2012).
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    def strings_of(items) -> set[str] | None:
        """All strings of a sub-expression, if they are few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                some = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                some = {chr(v).lower() for _, v in arg}
            elif name == "SUBPATTERN":
                some = strings_of(arg[-1])
            elif name == "BRANCH":
                parts = [strings_of(x) for x in arg[1]]
                some = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] == 1:
                some = strings_of(arg[2])
                some = some and (some | {""} if arg[0] == 0 else some)
            else:
                some = None
            if some is None or len(out) * len(some) > LIMIT:
                return None
            out = {a + b for a in out for b in some}
        return out

    def walk(items) -> None:
        run = {""}
        for item in items:
            some = strings_of([item])
            if some is not None and len(run) * len(some) <= LIMIT:
                run = {a + b for a in run for b in some}
                continue
            close(run)
            run = {""} if some is None else some
            name, arg = str(item[0]), item[1]
            if some is None and name == "SUBPATTERN":
                walk(arg[-1])
            elif some is None and name == "MAX_REPEAT" and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(re._parser.parse(pattern))
    return clauses


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, doc_id, text_hash), one for each asked-for trigram a lower-cased text has."""
    low = docs.select("doc_id", common.unicode_hash().alias("text_hash"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("doc_id", "text_hash", F.explode(hits).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(doc_id, text_hash, rules): bit i is set where rule i's query holds on the document's postings."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = -(-len(trigrams) // 60)
    seen = index.groupBy("doc_id", "text_hash").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.expr(f"shiftleft(1L, trigram % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(words)])

    def has(some: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            bits = sum(1 << place[t] % 60 for t in some if place[t] // 60 == w)
            if bits:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(bits)) == bits)
        return out

    mask = F.lit(0)
    for i, r in enumerate(rules):
        if query := trigram_query(r.pattern):
            holds = F.lit(True)
            for clause in query:
                one = F.lit(False)
                for some in clause:
                    one = one | has(some)
                holds = holds & one
            mask = mask + F.when(holds, 1 << i).otherwise(0)
    return seen.select("doc_id", "text_hash", mask.alias("rules")).where("rules > 0")


SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule: struct(start, rank, kind, end), code points, end exclusive.

    The text between matches (split) and the matches (extract all) follow each other, so running sums of
    their lengths are the places.
    """
    pattern = F.lit(rule.pattern)
    parts = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, 0), lambda x: F.length(x))
    held = F.transform(F.regexp_extract_all(text, pattern, rule.group), lambda x: F.length(x)) if rule.group else whole

    def placed(m: Column) -> Column:
        """m: array of struct(gap, len, held) in order of the matches."""
        at = common.prefixes(F.transform(m, lambda x: x["gap"] + x["len"]), F.lit(0), lambda a, b: a + b)
        return F.filter(
            F.zip_with(m, at, lambda x, a: F.when(x["held"] >= rule.least, F.struct((a + x["gap"]).alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (a + x["gap"] + x["len"]).alias("end")))),
            lambda s: s.isNotNull(),
        )

    sliced = common.let(F.struct(parts.alias("p"), whole.alias("w"), held.alias("h")), lambda z: F.arrays_zip(F.slice(z["p"], F.lit(1), F.size(z["w"])).alias("gap"), z["w"].alias("len"), z["h"].alias("held")))
    return common.let(sliced, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, spans): every row of docs as a struct with its columns, and its spans, an array of struct(start, rank, kind,
    end) by start, then rank.

    Null text is empty. Rows with the same id and text get the same spans; a null id matches its own postings. Work
    follows the text's length plus its matches, so long texts with very many secrets are no special case.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), common.unicode_hash().alias("hash"))
    grams = sorted({t for r in rules for clause in trigram_query(r.pattern) for some in clause for t in some})
    asked = F.lit(None).cast("int").alias("asked")
    if grams:
        found = common.checkpoint(candidates(build_index(docs.select("doc_id", "text"), grams), rules, grams).toDF("id", "hash", "asked"))
        table = common.key_filter(found, ["id", "hash"])
        f = found.toDF("_id", "_hash", "asked")
        may = common.filtered(rows, table, ["id", "hash"]).join(f, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").select("row", "asked")
        rows = common.filtered(rows, table, ["id", "hash"], inside=False).select("row", asked).unionByName(may)
    else:
        rows = rows.select("row", asked)
    text, none = F.coalesce(F.col("row.text"), F.lit("")), F.expr(f"cast(array() as array<{SPAN}>)")
    parts = []
    for i, r in enumerate(rules):
        holds = F.coalesce(F.col("asked"), F.lit(0)).bitwiseAND(F.lit(1 << i)) > 0 if trigram_query(r.pattern) else F.lit(True)
        parts.append(F.when(holds & text.rlike(r.pattern), _spans(text, r, i)).otherwise(none))
    return rows.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


CUT = 1024


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span as ``[kind]``. It is cut into blocks of CUT characters once, so that a gap between two
    spans is read from the blocks it lies in and not from the text's start."""

    def put(z: Column) -> Column:
        blocks = z["blocks"]

        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / CUT).cast("int")
            own = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / CUT).cast("int") - first + 1), "")
            return F.when(b <= a, F.lit("")).otherwise(F.substring(own, a - first * CUT + 1, b - a))

        pieces = F.zip_with(z["spans"], z["before"], lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), between(F.array_max(F.transform(z["spans"], lambda s: s["end"])), z["size"]))

    before = common.prefixes(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), 0)
    return common.let(F.struct(blocks.alias("blocks"), spans.alias("spans"), before.alias("before"), F.length(text).alias("size")), put)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs with every span's text replaced by ``[kind]``; overlapping spans become one, named by the first.

    All other columns come back as they were, whatever their names. Null text comes back empty; rows that repeat an id or
    a text are each redacted.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    clean = F.when(F.size("spans") == 0, text).otherwise(_replaced(text, F.col("spans")))
    return scan(docs, rules).select(*[clean.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    cols, parts = [], []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        cols.append(f"regexp_extract_all(t, '{p}', 0) AS w{i}, regexp_extract_all(t, '{p}', {r.group}) AS h{i}, string_split_regex(t, '{p}') AS s{i}")
        at = f"list_sum(list_transform(s{i}[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(w{i}[1:j-1], lambda x: length(x))), 0)"
        every = f"list_transform(range(1, len(w{i}) + 1), lambda j: {{'a': CAST({at} AS BIGINT), 'r': {i}, 'k': '{r.kind}', 'b': CAST({at} + length(w{i}[j]) AS BIGINT), 'h': length(h{i}[j])}})"
        parts.append(f"list_filter({every}, lambda x: x.h >= {r.least})")
    text = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.a || ':' || x.b), ',')"
    return f"""
WITH m AS (SELECT doc_id, t, {', '.join(cols)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
f AS (SELECT doc_id, {', '.join(f'{p} AS f{i}' for i, p in enumerate(parts))} FROM m)
SELECT doc_id, CAST(len(f0) AS BIGINT) AS n_assign, CAST(len(f1) AS BIGINT) AS n_access, CAST(len(f2) AS BIGINT) AS n_hex,
  sha256({text.format('list_sort(list_concat(list_concat(f0, f1), f2))')}) AS base_sha256,
  {text.format('list_sort(list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(f0, f1), f2), f3), f4), f5), f6))')} AS spans
FROM f"""


ORACLE = _oracle()
