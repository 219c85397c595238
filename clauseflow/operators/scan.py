"""Rule scan: clauses against the taxonomy's signals, and the findings made of the hits."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseflow import constants as K
from clauseflow import taxonomy as T
from clauseflow.functions.text import WS, severity_rank, trim
from clauseflow.operators.normalize import once


def categories(spark: SparkSession, taxonomy: list = T.CATEGORIES) -> DataFrame:
    """The taxonomy as a table: category, pos, label, grp, baseline, what, why, advice."""
    rows = [(c[0], i, *c[1:6], T.ADVICE.get(c[0], "建议阅读原文确认。")) for i, c in enumerate(taxonomy)]
    return spark.createDataFrame(rows, "category string, pos int, label string, grp string, baseline string, what string, why string, advice string")


def signals(spark: SparkSession, taxonomy: list = T.CATEGORIES) -> DataFrame:
    rows = [(c[0], i, p, ic) for c in taxonomy for i, (p, ic) in enumerate(c[6])]
    return spark.createDataFrame(rows, "category string, pos int, pattern string, ignore_case boolean")


def severities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i, T.SEVERITY_LABELS[s], T.SEVERITY_WEIGHTS[s]) for i, s in enumerate(T.SEVERITIES)], "severity string, rank int, label string, weight int")


def needed(pattern: str) -> frozenset[str] | None:
    """Texts of which every match of the pattern has one, or null where none can be told; read off the parsed pattern."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None  # Java's syntax, not Python's
    return None if parsed.state.flags & ~re.UNICODE.value else _needed(parsed)


def _needed(items) -> frozenset[str] | None:
    found, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        found, run = [*found, frozenset([run])] if run else found, ""
        inner = None
        if op is _constants.SUBPATTERN:
            inner = None if value[1] or value[2] else _needed(value[3])  # flags of its own
        elif op is _constants.BRANCH:
            each = [_needed(x) for x in value[1]]
            inner = None if None in each else frozenset().union(*each)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        found += [inner] if inner else []
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def any_of(texts: frozenset[str]) -> str:
    """A pattern that finds any of the texts, as a tree of their first characters: most places fail at once."""
    if "" in texts:
        return ""
    heads = sorted({t[0] for t in texts})
    rest = [(h, any_of(frozenset(t[1:] for t in texts if t[0] == h))) for h in heads]
    parts = [re.escape(h) + r for h, r in rest]
    return parts[0] if len(parts) == 1 else f"(?=[{''.join(map(re.escape, heads))}])(?:{'|'.join(parts)})"


def _necessary(pattern: str, ignore_case: bool) -> frozenset[str] | None:
    """As `needed`; of patterns that ignore case in lower case, and only where these are plain ASCII."""
    if ignore_case:
        return needed(pattern.lower()) if pattern.isascii() and "\\" not in pattern else None
    return needed(pattern)


def gate(text: Column, patterns: list[str], ignore_case: bool) -> Column:
    """Whether a text may match one of the patterns: never false where one matches."""
    each = [_necessary(p, ignore_case) for p in patterns]
    if not patterns or None in each:
        return F.lit(bool(patterns))
    texts, t = frozenset().union(*each), F.lower(text) if ignore_case else text
    plain, wide = (frozenset(x for x in texts if x.isascii() is a) for a in (True, False))
    out = t.rlike(any_of(plain)) if plain else F.lit(False)
    # Texts of ASCII characters alone are told at once, and elsewhere those characters are passed over.
    return out | (t.rlike(r"[^\x00-\x7f]") & t.rlike(r"(?![\x00-\xff])" + any_of(frozenset(x for x in wide if x[0] > "\xff")))) if wide and all(x[0] > "\xff" for x in wide) else t.rlike(any_of(texts))


def prescan(clauses: DataFrame, taxonomy: list = T.CATEGORIES) -> DataFrame:
    """One row per clause and category with a match: the clause's columns, category, cat_pos, severity, matches, match_indexes.

    Each signal is a literal pattern, compiled once; clauses are read once for all signals, nothing is joined. A signal's
    first match is kept, cut to MATCH_CHARS, of at most KEPT_MATCHES signals in their order. Signals run on clauses that have
    a text that one of them needs; those that ignore case are gated apart from the others.
    """
    text, found = F.col("text"), []
    every = [s for c in taxonomy for s in c[6]]
    gated = once(clauses, _cased=gate(text, [p for p, ic in every if not ic], False), _uncased=gate(text, [p for p, ic in every if ic], True))

    def may_match(p: str, ic: bool) -> Column:
        out = F.col("_uncased" if ic else "_cased")
        texts = _necessary(p, ic)
        return out if texts is None else out & reduce(Column.__or__, ((F.lower(text) if ic else text).contains(t) for t in sorted(texts)))

    for pos, (name, _, _, baseline, _, _, patterns) in enumerate(taxonomy):
        if patterns:
            firsts = F.array(*(F.when(may_match(p, ic), F.regexp_extract(text, ("(?i)" if ic else "") + p, 0)).otherwise("") for p, ic in patterns))
            found.append(F.struct(F.lit(name).alias("category"), F.lit(pos).alias("cat_pos"), F.lit(baseline).alias("severity"), F.slice(F.filter(firsts, lambda m: m != ""), 1, K.KEPT_MATCHES).alias("m")))
    hits = F.when(F.col("_cased") | F.col("_uncased"), F.filter(F.array(*found), lambda s: F.size(s["m"]) > 0))
    # explode_outer, as the optimizer would evaluate all patterns once more to filter out rows without matches.
    rows = gated.select("*", F.explode_outer(hits).alias("hit")).where("hit IS NOT NULL")
    return rows.select(
        *clauses.columns, "hit.category", "hit.cat_pos", "hit.severity", F.transform("hit.m", lambda m: F.substring(m, 1, K.MATCH_CHARS)).alias("matches"),
        F.transform("hit.m", lambda m: F.instr(text, m) - 1).alias("match_indexes"),
    )


def anchor(text: Column, match: Column, at: Column) -> Column:
    """Where to quote from: the first occurrence behind the heading line, where the match lies in that line and comes again."""
    line_end = F.instr(text, F.lit("\n")) - 1
    again = F.call_function("locate", match, text, line_end + 2) - 1
    return F.when((line_end >= 0) & (at < line_end) & (again >= 0), again).otherwise(at)


def with_sentence(df: DataFrame, text: str, match: str, at: str, most: int = K.SENTENCE_CHARS) -> DataFrame:
    """Adds quote and quote_start: the sentence around the match at `at`, cut to `most` characters that hold the match."""
    t, m, i = F.col(text), F.col(match), F.col(at)
    left = F.substring(t, F.lit(1), i + 1)
    df = df.withColumn("_s", i + 1 - F.length(F.regexp_extract(left, "[^。！？；\n]*$", 0)))
    scan = F.least(i + F.greatest(F.length(m), F.lit(1)), F.length(t))
    df = df.withColumn("_e", scan + F.length(F.regexp_extract(F.substring(t, scan + 1, F.length(t)), "^[^。！？；\n]*[。！？；\n]?", 0)))
    df = df.withColumn("_raw", F.substring(t, F.col("_s") + 1, F.col("_e") - F.col("_s"))).withColumn("_q", trim(F.col("_raw")))
    df = df.withColumn("_at", F.col("_s") + F.length("_raw") - F.length(F.regexp_replace("_raw", rf"^[{WS}]+", "")))
    rel = i - F.col("_at")
    skip = F.when((F.length("_q") > most) & (rel > 0) & (rel + F.length(m) > most), F.greatest(rel - 20, F.lit(0))).otherwise(F.lit(0))
    df = df.withColumn("_skip", skip).withColumn("quote_start", F.col("_at") + F.col("_skip"))
    return df.withColumn("quote", trim(F.substring(F.col("_q"), F.col("_skip") + 1, F.lit(most)))).drop("_s", "_e", "_raw", "_q", "_at", "_skip")


def findings(clauses: DataFrame, taxonomy: list = T.CATEGORIES) -> DataFrame:
    """doc_id, finding_id, rank, clause_id, clause_heading, category, severity, quote, title, explanation, impact, advice,
    hidden, wording, start, end, match_type, cross_clause, verified and detected_by, numbered by severity and place."""
    hits = prescan(clauses, taxonomy).withColumn("m", F.get("matches", F.lit(0)))
    hits = hits.withColumn("i", anchor(F.col("text"), F.col("m"), F.get("match_indexes", F.lit(0))))
    quoted = with_sentence(hits, "text", "m", "i")
    dim = F.broadcast(categories(clauses.sparkSession, taxonomy).drop("pos", "baseline", "grp"))  # one row per category
    order = Window.partitionBy("doc_id").orderBy("sev", "start", "idx", "cat_pos")
    # What a category says follows once hits are numbered, so that it isn't shuffled with them.
    out = quoted.withColumn("sev", severity_rank(F.col("severity"))).withColumn("start", (F.col("start") + F.col("quote_start")).cast("int"))
    out = out.select("doc_id", "clause_id", "heading", "category", "severity", "quote", "matches", "start", "sev", "idx", "cat_pos")
    out = out.withColumn("rank", F.row_number().over(order)).join(dim, "category")
    return out.select(
        "doc_id", "clause_id", F.col("heading").alias("clause_heading"), "category", "severity", "quote", F.col("label").alias("title"), F.col("what").alias("explanation"),
        F.col("why").alias("impact"), "advice", F.lit(False).alias("hidden"), F.col("matches").alias("wording"), "start",
        (F.col("start") + F.length("quote")).cast("int").alias("end"), F.lit("exact").alias("match_type"), F.lit(False).alias("cross_clause"), F.lit(True).alias("verified"),
        F.lit("rule").alias("detected_by"), "rank", F.concat(F.lit("f"), F.col("rank").cast("string")).alias("finding_id"),
    )


def filter_findings(found: DataFrame, severity: str = "all", hidden_only: bool = False, contains: str = "", taxonomy: list = T.CATEGORIES) -> DataFrame:
    """Findings of one severity, hidden ones, or with a word in title, quote, category or explanation, in any case."""
    out = found if severity == "all" else found.where(F.col("severity") == severity)
    out = out.where("hidden") if hidden_only else out
    q = contains.strip().lower()
    if not q:
        return out
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for c in taxonomy for v in (c[0], c[1]))), F.col("category")), F.col("category"))
    places = [F.col("title"), F.col("quote"), label, F.col("category"), F.col("explanation")]
    hit = F.lit(False)
    for p in places:
        hit = hit | F.lower(F.coalesce(p, F.lit(""))).contains(q)
    return out.where(hit)


def merge_spans(found: DataFrame, text_length: DataFrame | None = None) -> DataFrame:
    """Highlights: doc_id, start, end, ids and severity; spans that overlap become one, spans that only touch stay apart.

    Spans that are empty, negative or, with text_length (doc_id, length), beyond the text are left out.
    """
    ok = found.where((F.col("end") > F.col("start")) & (F.col("start") >= 0))
    if text_length is not None:
        ok = ok.join(text_length, "doc_id").where(F.col("end") <= F.col("length"))
    order = Window.partitionBy("doc_id").orderBy("start", "end", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ok.withColumn("new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("nth", F.row_number().over(order))
    marked = marked.withColumn("island", F.sum("new").over(order)).withColumn("sev", severity_rank(F.col("severity")))
    grouped = marked.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "finding_id"))), lambda x: x["finding_id"]).alias("ids"), F.min_by("severity", "sev").alias("severity")
    )
    return grouped.drop("island")
