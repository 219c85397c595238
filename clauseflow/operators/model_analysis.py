"""Analysis with a model: clauses packed into batches, prompts with hints, answers read and checked, and one report per document.

A model is a callable (see `providers`); without any, or where all batches of a document fail, its rule findings stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow import constants as K
from clauseflow import taxonomy as T
from clauseflow.functions.modeljson import parse_udf
from clauseflow.functions.text import estimate_tokens
from clauseflow.operators import report, retrieve, scan, verify
from clauseflow.providers import Model, call_model
from clauseflow.session import cut_lineage

QUOTE_SHOWN, NOTES_SHOWN = 160, 80
# What is reported where a model found nothing.
EMPTY_SCORE, EMPTY_VERDICT = 8, "未发现明显风险条款"
_FINDING = "array<struct<clauseId:string,category:string,severity:string,quote:string,title:string,explanation:string,impact:string,advice:string,hidden:boolean,wording:array<string>>>"
_REPORT = "struct<riskScore:double,verdict:string,summary:string>"


@dataclass
class ModelAnalysis:
    """findings: verified, with status; mode per document: model, partial or heuristic; warnings: distinct, in order."""

    findings: DataFrame
    reports: DataFrame
    batches: DataFrame


def clause_index(clauses: DataFrame) -> DataFrame:
    """Clauses without their text."""
    return clauses.select("doc_id", "clause_id", "idx", "heading", "start", "end", F.length("text").alias("chars"), "heading_rule")


def compact_findings(found: DataFrame) -> DataFrame:
    """What a report needs of findings, as one JSON array per document."""
    x = F.struct("rank", F.struct(F.col("clause_id").alias("clauseId"), "category", "severity", F.coalesce("hidden", F.lit(False)).alias("hidden"), "title", F.substring("quote", 1, QUOTE_SHOWN).alias("quote"), "explanation").alias("f"))
    return found.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(x)), lambda r: r["f"])).alias("findings"))


def compact_notes(notes: DataFrame, most: int = NOTES_SHOWN) -> DataFrame:
    """The first notes per document: clause, plain words and tone, as one JSON array."""
    x = F.struct(F.substring("note_id", 2, 9).cast("int").alias("n"), F.struct(F.col("clause_id").alias("clauseId"), "plain", "tone").alias("f"))
    return notes.groupBy("doc_id").agg(F.to_json(F.transform(F.slice(F.array_sort(F.collect_list(x)), 1, most), lambda r: r["f"])).alias("notes"))


def hints(prescanned: DataFrame) -> DataFrame:
    """Categories that rules expect in a clause: (doc_id, clause_id, hints), in the order of the taxonomy."""
    order = F.array(*(F.lit(c[0]) for c in T.CATEGORIES))
    x = F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("category")).alias("n"), F.col("category").alias("c"))))
    return prescanned.groupBy("doc_id", "clause_id").agg(F.transform(x, lambda r: r["c"]).alias("hints"))


def map_prompts(clauses: DataFrame, prescanned: DataFrame, most: int = K.BATCH_CHARS) -> DataFrame:
    """doc_id, batch, prompt and tokens: one prompt per batch of clauses, each clause with its marker, heading, text and hints."""
    c = clauses.join(retrieve.batches(clauses, most).select("doc_id", "clause_id", "batch"), ["doc_id", "clause_id"]).join(hints(prescanned), ["doc_id", "clause_id"], "left")
    hint = F.when(F.size("hints") > 0, F.concat(F.lit("\n[本地规则预扫描提示] 该条款可能涉及："), F.array_join("hints", "、"), F.lit("（仅供参考，可能误报，请以原文为准）"))).otherwise(F.lit(""))
    part = F.concat(F.lit("<<<"), F.col("clause_id"), F.lit(">>> "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.col("text"), hint, F.lit("\n"))
    per = c.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("idx", part.alias("p")))).alias("x"))
    head = F.concat(F.lit("共 "), F.size("x").cast("string"), F.lit(" 个条款。请为每个实质性条款写解读，并对可疑之处输出风险：\n\n"))
    prompt = F.concat(head, F.array_join(F.transform("x", lambda r: r["p"]), "\n"))
    return per.select("doc_id", "batch", prompt.alias("prompt"), estimate_tokens(prompt).cast("long").alias("tokens"))


def reduce_prompts(found: DataFrame, notes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and prompt; docs has doc_id and title."""
    x = docs.join(compact_findings(found), "doc_id", "left").join(compact_notes(notes), "doc_id", "left")
    prompt = F.concat(F.lit("协议标题："), F.coalesce("title", F.lit("")), F.lit("\n风险条目：\n"), F.coalesce("findings", F.lit("[]")), F.lit("\n条款解读：\n"), F.coalesce("notes", F.lit("[]")))
    return x.select("doc_id", prompt.alias("prompt"))


def read_findings(answers: DataFrame) -> DataFrame:
    """Raw findings of the answers, numbered per document in the order of batches, as `verify_findings` takes them."""
    parsed = answers.where(F.col("answer").isNotNull()).withColumn("p", parse_udf(F.col("answer"), F.lit("findings")))
    x = parsed.select("doc_id", "batch", F.posexplode(F.from_json(F.get_json_object("p.json", "$.findings"), _FINDING)).alias("n", "f"))
    return x.select("doc_id", (F.col("batch") * 10_000 + F.col("n")).alias("ord"), F.col("f.clauseId").alias("clause_id"), *(F.col(f"f.{c}").alias(c) for c in ("category", "severity", "quote", "title", "explanation", "impact", "advice")), F.coalesce("f.hidden", F.lit(False)).alias("hidden"), F.coalesce("f.wording", F.array().cast("array<string>")).alias("wording"))


def batch_outcome(answers: DataFrame) -> DataFrame:
    """Per document: batches, failed, tokens (their sum), mode and the distinct warnings in the order of batches."""
    warning = F.when(F.col("error").isNotNull(), F.col("error"))
    per = answers.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("tokens").alias("tokens"),
        F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("batch", warning.alias("w")))), lambda r: r["w"].isNotNull()), lambda r: r["w"])).alias("warnings"),
    )
    mode = F.when(F.col("failed") == 0, F.lit("model")).when(F.col("failed") < F.col("batches"), F.lit("partial")).otherwise(F.lit("heuristic"))
    return per.withColumn("mode", mode)


def empty_report(computed: Column) -> tuple[Column, Column]:
    """Score and verdict where nothing was found."""
    return F.lit(EMPTY_SCORE), F.lit(EMPTY_VERDICT)


def analyze(docs: DataFrame, clauses: DataFrame, models: list[Model], parallel: int = 3) -> ModelAnalysis:
    """docs has doc_id, title and text. The first model reads the batches; the report comes from the first of `models`, last
    one first, that answers with a score, and from the findings' own weights where none does."""
    clauses = cut_lineage(clauses)
    prescanned, rules = scan.prescan(clauses), cut_lineage(scan.findings(clauses))
    prompts = map_prompts(clauses, prescanned)
    answers = call_model(prompts, models[0], parallel=parallel, as_json=True) if models else prompts.select("*", F.lit(None).cast("string").alias("answer"), F.lit("no model").alias("error"), F.lit(0).alias("tries"))
    answers = cut_lineage(answers)
    outcome = cut_lineage(batch_outcome(answers))
    checked = verify.verify_findings(cut_lineage(read_findings(answers)), clauses, docs.select("doc_id", "text")).where("status = 'kept'")
    shared = ["doc_id", "clause_id", "category", "severity", "quote", "title", "explanation", "start", "end", "hidden"]
    by_rule = rules.join(outcome.where("mode = 'heuristic'").select("doc_id"), "doc_id", "left_semi")
    found = checked.select(*shared, "finding_id", F.lit("model").alias("detected_by")).unionByName(by_rule.select(*shared, "finding_id", F.lit("heuristic").alias("detected_by")))
    scores = report.scores(found, docs.select("doc_id")).select("doc_id", F.col("score").alias("computed"))
    info = docs.join(scores, "doc_id").join(outcome, "doc_id", "left").join(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_findings")), "doc_id", "left")
    asked = reduce_prompts(found.withColumn("rank", F.substring("finding_id", 2, 9).cast("int")), report.notes(clauses, rules), docs)
    said = None
    for i, model in enumerate(reversed(models[:2])):
        one = call_model(asked, model, parallel=parallel, as_json=True).withColumn("p", parse_udf(F.col("answer"), F.lit(None).cast("string")))
        one = one.select("doc_id", F.from_json("p.json", _REPORT).alias(f"said_{i}"))
        one = cut_lineage(one)
        said = one if said is None else said.join(one, "doc_id")
    first = F.coalesce(*(F.when(F.col(f"said_{i}.riskScore").isNotNull(), F.col(f"said_{i}")) for i in range(min(len(models), 2))), F.lit(None).cast(_REPORT))
    info = (info.join(said, "doc_id", "left") if said is not None else info).withColumn("r", first).withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    score = report.calibrate(F.col("r.riskScore"), F.col("computed"), F.col("n_findings"))
    none = (F.col("n_findings") == 0) & (F.col("mode") != "heuristic")
    low, nothing = empty_report(F.col("computed"))
    reports = info.select("doc_id", F.when(none, low).otherwise(score).alias("risk_score"), F.when(none, nothing).otherwise(F.coalesce("r.verdict", report.verdict(score))).alias("verdict"), "n_findings", "mode", "batches", "failed", "tokens", "warnings")
    return ModelAnalysis(found, reports, answers)
