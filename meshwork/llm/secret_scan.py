"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex is analysed for the literal strings that every match must contain; their trigrams form a Boolean query
(any clause, all of its trigrams). Postings (trigram, document) are built for the trigrams that the rules ask for, clauses
are met by intersecting postings, and only candidates are verified with the regex. A rule without mandatory trigrams
scans every text.
"""

from __future__ import annotations

import itertools
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STRINGS = 64  #: a run of literals with more readings than this is cut; it only makes a query weaker


@dataclass(frozen=True)
class Rule:
    """``regex`` is read alike by Java and Python. A match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: A text is passed once: a rule that begins with an unbounded run is tried only where that run begins, and a header of any
#: length is read on only if what must follow it is there. Kinds in the order in which spans with one start are listed. The
#: first three are the base. The spans of ``jwt`` and ``url`` begin with the run of characters that holds the header or scheme.
BASE_RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
OWN_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10})[A-Za-z0-9_-]*?eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url", r"(?<![a-z0-9+.-])[0-9+.-]*[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]{3,}@"),
)
RULES = BASE_RULES + OWN_RULES


def trigram_query(regex: str) -> frozenset[frozenset[str]] | None:
    """Boolean query in disjunctive form: a match holds all trigrams (of the lower-cased text) of at least one clause.

    None if some match may hold no trigram at all, so that every text must be scanned.
    """
    clauses: set[frozenset[str]] = {frozenset()}

    def meet(strings: set[str]) -> None:
        nonlocal clauses
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        joined = {a | b for a, b in itertools.product(clauses, options)}
        clauses = joined if len(joined) <= MAX_STRINGS else clauses

    def readings(op, arg) -> set[str] | None:
        """All strings that the node can match, lower-cased; None if there are too many or they aren't known."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN:
            out = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    out.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 8:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            return {""}
        if op is C.SUBPATTERN:
            return run(arg[3])
        if op is C.BRANCH:
            parts = [run(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] <= 2:
            one = run(arg[2])
            return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(one, repeat=n)}
        return None

    def run(nodes) -> set[str] | None:
        out = {""}
        for op, arg in nodes:
            more = readings(op, arg)
            if more is None or len(out) * len(more) > MAX_STRINGS:
                return None
            out = {a + b for a, b in itertools.product(out, more)}
        return out

    def walk(nodes) -> None:
        """Cut a sequence into runs of known readings; each run must be met. Unknown nodes that must occur are entered."""
        known = {""}
        for op, arg in nodes:
            more = readings(op, arg)
            if more is not None and len(known) * len(more) <= MAX_STRINGS:
                known = {a + b for a, b in itertools.product(known, more)}
                continue
            meet(known)
            known = {""}
            if op is C.SUBPATTERN:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                walk(arg[2])
        meet(known)

    walk(parser.parse(regex))
    if frozenset() in clauses:
        return None
    return frozenset(c for c in clauses if not any(other < c for other in clauses))  # a clause that asks for more adds nothing


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index (trigram, id), for the trigrams that rules ask for; null ids and texts have no postings."""
    asked = F.array(*[F.lit(t) for t in trigrams])
    # the one-element array binds the lower-cased text to a variable, so that it is made once and not once a trigram
    held = F.transform(F.array(F.lower(F.col(text_col))), lambda low: F.filter(asked, lambda t: F.contains(low, t)))[0]
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__cid"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """Per document the kinds whose query its postings meet: lists are intersected by grouping on the document."""
    held = index.groupBy("__cid").agg(F.collect_set("trigram").alias("__held"))  # at most as many as the rules ask for

    def met(clauses: frozenset[frozenset[str]]) -> Column:
        has_all = [F.size(F.array_intersect(F.col("__held"), F.array(*[F.lit(t) for t in sorted(c)]))) == len(c) for c in sorted(clauses, key=sorted)]
        out = has_all[0]
        for x in has_all[1:]:
            out = out | x
        return out

    kinds = F.array_compact(F.array(*[F.when(met(q), F.lit(k)) for k, q in queries.items()]))
    return held.select("__cid", kinds.alias("__kinds")).where(F.size("__kinds") > 0)


def running_sums(values: Column) -> Column:
    """Sums of an array's first 1, 2, ... values, by doubling: each step adds to every sum the one that many places before it."""
    n = F.size(values)
    doublings = F.when(n > 1, F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1)).otherwise(F.array().cast("array<int>"))

    def step(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        earlier = F.concat(F.array_repeat(F.lit(0), back), F.slice(sums, 1, n - back))
        return F.zip_with(sums, earlier, lambda a, b: a + b)

    return F.aggregate(doublings, values, step)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind order, end) of a rule's leftmost non-overlapping matches, in code points.

    The text falls into the pieces between matches and the matches themselves; the running sums of their lengths are the
    places. n matches take n log n steps.
    """
    gaps = F.transform(F.split(text, rule.regex, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.char_length)
    good = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.char_length)
    # the last piece has no match after it; one-element arrays bind what is used twice
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("all"), good.alias("part")), lambda x: x["all"].isNotNull())

    def spans(found: Column) -> Column:
        ends = running_sums(F.transform(found, lambda x: x["gap"] + x["all"]))
        placed = F.zip_with(found, ends, lambda x, end: F.struct(x["part"].alias("part"), F.struct((end - x["all"]).alias("start"), F.lit(order).alias("kind"), end.alias("end")).alias("span")))
        return F.transform(F.filter(placed, lambda x: x["part"] >= rule.least), lambda x: x["span"])

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(rule.regex), F.transform(F.array(steps), spans)[0]).otherwise(none)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets: id, spans array<struct<start, kind (place of the rule in ``rules``), end>> sorted.

    One row per input row. Null texts count as empty. Rows that share an id share candidacy, which only adds checks; rows
    without an id are checked by every rule. Texts of any length are read whole. Spans of one start are ordered by kind. Empty tables give an empty result; other columns are ignored.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    asked = {k: q for k, q in queries.items() if q is not None}
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if asked:
        trigrams = sorted({t for q in asked.values() for c in q for t in c})
        found = candidates(postings(docs, trigrams, id_col, text_col), asked)
        rows = rows.join(found, rows["__id"] == found["__cid"], "left")
    else:
        rows = rows.withColumn("__kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        spans = rule_spans(F.col("__text"), r, i)
        if r.kind in asked:
            spans = F.when(F.coalesce(F.array_contains("__kinds", r.kind), F.lit(False)) | F.col("__id").isNull(), spans).otherwise(none)
        parts.append(spans)
    return rows.select(F.col("__id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
