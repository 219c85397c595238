"""Scores, summaries, notes, interactions and reports of findings, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow import constants as K
from clauseflow import taxonomy as T
from clauseflow.functions.text import WS, escape_html, risk_score, severity_rank, trim, verdict

_LABEL = {c[0]: c[1] for c in T.CATEGORIES}


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def scores(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, score, verdict for every doc_id of docs; documents without findings score 0."""
    weights = found.groupBy("doc_id").agg(F.sum(_lookup(T.SEVERITY_WEIGHTS, F.col("severity"))).alias("w"))
    score = risk_score(F.coalesce(F.col("w"), F.lit(0)))
    return docs.select("doc_id").join(weights, "doc_id", "left").select("doc_id", score.alias("score"), verdict(score).alias("verdict"))


def category_summary(found: DataFrame) -> DataFrame:
    """doc_id, pos, category, severity (worst), count and note, worst categories first, then as findings are numbered."""
    note = {c[0]: c[4][:60] for c in T.CATEGORIES}
    rows = found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("count"), F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.min("rank").alias("first"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy(severity_rank(F.col("severity")), "first"))
    return rows.select("doc_id", pos.alias("pos"), "category", "severity", "count", F.coalesce(_lookup(note, F.col("category")), F.lit("")).alias("note"))


def severity_counts(found: DataFrame) -> DataFrame:
    """doc_id and a column n_<severity> for each severity."""
    return found.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in T.SEVERITIES))


def group_rollup(found: DataFrame) -> DataFrame:
    """Counts by group of categories and category, with subtotals (null) and the total (both null)."""
    grp = {c[0]: c[2] for c in T.CATEGORIES}
    return found.withColumn("grp", _lookup(grp, F.col("category"))).rollup("grp", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def clause_tones(clauses: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, clause_id, idx and tone: what the worst finding of a clause makes of it."""
    worst = found.groupBy("doc_id", "clause_id").agg(F.min(severity_rank(F.col("severity"))).alias("worst"))
    tone = F.when(F.col("worst") <= 1, F.lit("unfavorable")).when(F.col("worst").isNotNull(), F.lit("mixed")).otherwise(F.lit("neutral"))
    return clauses.select("doc_id", "clause_id", "idx").join(worst, ["doc_id", "clause_id"], "left").select("doc_id", "clause_id", "idx", tone.alias("tone"))


def notes(clauses: DataFrame, found: DataFrame) -> DataFrame:
    """Short notes on the first MAX_NOTES clauses of NOTE_FROM characters or more: doc_id, note_id, clause_id, clause_heading, plain, tone."""
    told = clauses.where(F.length(trim(F.col("text"))) >= K.NOTE_FROM).join(clause_tones(clauses, found).drop("idx"), ["doc_id", "clause_id"])
    told = told.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).where(F.col("nth") <= K.MAX_NOTES)
    one = lambda c: trim(F.regexp_replace(c, rf"[{WS}]+", " "))
    head = one(F.coalesce(F.col("heading"), F.lit("")))
    plain = F.when(F.length(head) < 4, F.regexp_extract(one(F.col("text")), "^[^。！？；.!?;]*[。！？；.!?;]?", 0)).otherwise(head)
    plain = F.when(F.length(plain) > 40, F.concat(F.substring(plain, 1, 40), F.lit("…"))).otherwise(plain)
    return told.select("doc_id", F.concat(F.lit("n"), F.col("nth").cast("string")).alias("note_id"), "nth", "clause_id", F.col("heading").alias("clause_heading"), plain.alias("plain"), "tone")


def interactions(found: DataFrame, rules: list = T.INTERACTIONS) -> DataFrame:
    """Categories that matter together: doc_id, interaction_id, clause_ids, severity, title, explanation, scenario.

    A rule's clauses are those of the first finding of each of its categories; one clause counts once.
    """
    spark = found.sparkSession
    first = found.groupBy("doc_id", "category").agg(F.min_by("clause_id", "rank").alias("clause_id"))
    dim = F.broadcast(spark.createDataFrame([(i, *r[0], *r[1:]) for i, r in enumerate(rules)], "pos int, need1 string, need2 string, severity string, title string, explanation string, scenario string"))
    a, b = first.select("doc_id", F.col("category").alias("need1"), F.col("clause_id").alias("c1")), first.select("doc_id", F.col("category").alias("need2"), F.col("clause_id").alias("c2"))
    both = a.join(dim, "need1").join(b, ["doc_id", "need2"])
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return both.select("doc_id", F.concat(F.lit("x"), nth.cast("string")).alias("interaction_id"), F.array_distinct(F.array("c1", "c2")).alias("clause_ids"), "severity", "title", "explanation", "scenario")


def suggestions(found: DataFrame, pool: list = K.QUESTION_POOL, most: int = 3) -> DataFrame:
    """doc_id and the first questions of the pool whose category the document has."""
    cats = found.groupBy("doc_id").agg(F.collect_set("category").alias("cats"))
    asked = F.array_compact(F.array(*(F.when(F.array_contains("cats", c), F.lit(q)) for c, q in pool)))
    return cats.select("doc_id", F.slice(asked, 1, most).alias("questions"))


def reports(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The report of every document: docs has doc_id, clause_count and total_chars.

    risk_score, verdict, summary, top_concerns, category_summary, actions and severity counts; one grouping of the findings.
    """
    f = F.struct("rank", "clause_id", "title", "severity", "impact", "explanation", "advice", "category")
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(f)).alias("fs"), F.sum(_lookup(T.SEVERITY_WEIGHTS, F.col("severity"))).alias("w"))
    df = docs.join(per, "doc_id", "left").withColumn("score", risk_score(F.coalesce(F.col("w"), F.lit(0))))
    fs = F.col("fs")
    rank = {s: i for i, s in enumerate(T.SEVERITIES)}
    cats = F.array_distinct(F.transform(fs, lambda x: x["category"]))
    worst = F.transform(
        cats, lambda c, i: F.struct(F.array_min(F.transform(F.filter(fs, lambda x: x["category"] == c), lambda x: _lookup(rank, x["severity"]))).alias("sev"), i.alias("i"), c.alias("category"), F.size(F.filter(fs, lambda x: x["category"] == c)).alias("count"))
    )
    df = df.withColumn("cs", F.array_sort(worst))
    label = lambda c: F.coalesce(_lookup(_LABEL, c), c)
    number = lambda s: F.size(F.filter(fs, lambda x: x["severity"] == s)).cast("string")
    top = F.array_join(F.transform(F.slice("cs", 1, 3), lambda c: label(c["category"])), "、")
    # The sentences of the summary.
    some = F.concat(
        F.lit("本地规则在 "), F.col("clause_count").cast("string"), F.lit(" 个条款中命中 "), F.size(fs).cast("string"), F.lit(" 处可疑表述，其中严重 "), number("critical"), F.lit(" 条、高 "), number("high"),
        F.lit(" 条，整体风险分 "), F.col("score").cast("string"), F.lit("。问题主要集中在"), top, F.lit("等方面。由于该结果由关键词规则生成，可能存在误报，请结合原文自行确认。"),
    )
    none = F.concat(F.lit("本地规则扫描未在约 "), F.col("total_chars").cast("string"), F.lit(" 字的协议中发现明显的红旗措辞。这并不等于协议没有问题——规则只能识别固定措辞，建议同时用模型分析以获得更全面的判断。"))
    notes_ = {c[0]: c[4][:60] for c in T.CATEGORIES}
    return df.select(
        "doc_id", F.col("score").alias("risk_score"), verdict(F.col("score")).alias("verdict"), F.when(F.col("fs").isNull(), none).otherwise(some).alias("summary"),
        F.when(F.col("fs").isNull(), F.lit(0)).otherwise(F.size("fs")).alias("n_findings"),
        F.transform(F.slice(fs, 1, 5), lambda x: F.struct(x["clause_id"].alias("clause_id"), x["title"].alias("title"), x["severity"].alias("severity"), F.coalesce(F.nullif(x["impact"], F.lit("")), x["explanation"]).alias("why"))).alias("top_concerns"),
        F.transform("cs", lambda c: F.struct(c["category"].alias("category"), F.element_at(F.array(*map(F.lit, T.SEVERITIES)), c["sev"] + 1).alias("severity"), c["count"].alias("count"), _lookup(notes_, c["category"]).alias("note"))).alias("category_summary"),
        F.slice(F.array_distinct(F.transform(fs, lambda x: x["advice"])), 1, 5).alias("actions"),
    )


def calibrate(score: Column, computed: Column, n_findings: Column) -> Column:
    """A model's score within 0 to 100, half-way to the computed one where they are more than CALIBRATE_FROM apart."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.coalesce(score, computed)).cast("int")))
    return F.when((n_findings > 0) & (F.abs(s - computed) > K.CALIBRATE_FROM), F.round(s * 0.5 + computed * 0.5).cast("int")).otherwise(s)


def markdown(reports_: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and the report as Markdown; docs has doc_id, title, chars and clause_count."""
    label = lambda c: F.coalesce(_lookup(_LABEL, c), c)
    sev = lambda s: F.coalesce(_lookup(T.SEVERITY_LABELS, s), s)
    entry = F.concat(
        F.lit("### "), F.col("rank").cast("string"), F.lit(". ["), sev(F.col("severity")), F.lit("] "), F.col("title"), F.lit("　`"), label(F.col("category")), F.lit("`\n\n> "), F.col("quote"), F.lit("\n\n- **出自**："),
        F.coalesce(F.nullif(F.col("clause_heading"), F.lit("")), F.col("clause_id")), F.lit("\n- **含义**："), F.col("explanation"), F.lit("\n- **影响**："), F.col("impact"), F.lit("\n- **建议**："), F.col("advice"), F.lit("\n"),
    )
    listed = found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("md")))), lambda x: x["md"]), "\n").alias("entries"))
    df = docs.join(reports_, "doc_id").join(listed, "doc_id", "left")
    concern = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". **["), sev(c["severity"]), F.lit("] "), c["title"], F.lit("**　`"), c["clause_id"], F.lit("`\n   - "), c["why"])
    row = lambda c: F.concat(F.lit("| "), label(c["category"]), F.lit(" | "), sev(c["severity"]), F.lit(" | "), c["count"].cast("string"), F.lit(" | "), c["note"], F.lit(" |"))
    part = lambda head, body: F.when(F.length(body) > 0, F.concat(F.lit(head), body, F.lit("\n")))
    return df.select(
        "doc_id",
        F.concat_ws(
            "\n", F.concat(F.lit("# 协议风险报告："), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("未命名协议")), F.lit("\n")),
            F.concat(F.lit("> 分析模式：本地规则（未调用模型）　|　协议规模："), F.format_number("chars", 0), F.lit(" 字 / "), F.format_number("clause_count", 0), F.lit(" 个条款\n")),
            F.concat(F.lit("## 一、整体评估\n\n**风险分："), F.col("risk_score").cast("string"), F.lit(" / 100　—　"), F.col("verdict"), F.lit("**\n\n"), F.col("summary"), F.lit("\n")),
            part("## 二、最需要关注的几条\n\n", F.array_join(F.transform("top_concerns", concern), "\n")),
            part("## 三、问题分布\n\n| 风险类别 | 最高等级 | 条目数 | 说明 |\n| --- | --- | --- | --- |\n", F.array_join(F.transform("category_summary", row), "\n")),
            part("## 四、建议采取的行动\n\n", F.array_join(F.transform("actions", lambda a: F.concat(F.lit("- [ ] "), a)), "\n")),
            F.concat(F.lit("## 六、风险条款清单\n\n"), F.coalesce(F.col("entries"), F.lit("本次分析未发现明显的风险条款。\n"))), F.lit("---\n\n仅供风险提示，**不构成法律意见**。"),
        ).alias("markdown"),
    )


def highlighted(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the text as HTML with merged spans marked."""
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ids", "severity"))).alias("spans"))
    df = docs.select("doc_id", F.col(text).alias("t")).join(per, "doc_id", "left")
    t = F.col("t")
    mark = lambda a, s: F.struct(
        F.concat(a["out"], escape_html(F.substring(t, a["at"] + 1, s["start"] - a["at"])), F.lit('<mark class="sev-'), s["severity"], F.lit('" data-ids="'), F.array_join(s["ids"], ","), F.lit('">'), escape_html(F.substring(t, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>")).alias("out"),
        s["end"].alias("at"),
    )
    walk = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), mark, lambda a: F.concat(a["out"], escape_html(F.substring(t, a["at"] + 1, F.length(t)))))
    return df.select("doc_id", F.coalesce(walk, escape_html(t)).alias("html"))
