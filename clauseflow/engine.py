"""The engine's calls in one place; each takes and returns DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import taxonomy as T
from clauseflow.functions import text as X
from clauseflow.operators import ask, history, model_analysis, normalize, report, scan, segment
from clauseflow.session import share_package
from clauseflow.sources import documents


@dataclass
class Analysis:
    """Tables of one analysis, by doc_id. status: ok, EMPTY_TEXT or NO_CLAUSES."""

    docs: DataFrame
    clauses: DataFrame
    findings: DataFrame
    notes: DataFrame
    interactions: DataFrame
    reports: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, taxonomy: list = T.CATEGORIES):
        self.spark, self.categories = share_package(spark), taxonomy

    def extract(self, files: DataFrame) -> DataFrame:
        return documents.extract_files(files)

    def analyze(self, docs: DataFrame) -> Analysis:
        """docs has doc_id, text and, if they have any, title."""
        base = docs if "title" in docs.columns else docs.withColumn("title", F.lit(""))
        normal = normalize.normalize_documents(base.select("doc_id", "title", "text"))
        clauses = segment.clauses(normal.select("doc_id", "text"))
        found = scan.findings(clauses, self.categories)
        counts = clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clause_count"))
        info = normal.join(counts, "doc_id", "left").withColumn("clause_count", F.coalesce("clause_count", F.lit(0)))
        status = F.when(X.is_blank(F.col("text")), F.lit("EMPTY_TEXT")).when(F.col("clause_count") == 0, F.lit("NO_CLAUSES")).otherwise(F.lit("ok"))
        info = info.select("doc_id", "title", "text", F.length("text").alias("chars"), "clause_count", "truncated", status.alias("status"))
        reports = report.reports(found, info.select("doc_id", "clause_count", F.col("chars").alias("total_chars")))
        return Analysis(info, clauses, found, report.notes(clauses, found), report.interactions(found), reports)

    def markdown(self, a: Analysis) -> DataFrame:
        return report.markdown(a.reports, a.findings, a.docs)

    def ask(self, questions: DataFrame, clauses: DataFrame, mode: str = "auto") -> DataFrame:
        """Extractive answers to questions (question_id, question)."""
        return ask.extractive(ask.context(clauses, questions, mode)[1], questions)

    def compare(self, older: Analysis, newer: Analysis) -> DataFrame:
        return history.compare(older.findings, newer.findings)

    def analyze_with_models(self, docs: DataFrame, models: list) -> model_analysis.ModelAnalysis:
        """docs has doc_id, title and text; models are callables from prompt to answer, see `model_analysis.analyze`."""
        normal = normalize.normalize_documents(docs.select("doc_id", "title", "text")).select("doc_id", "title", "text")
        return model_analysis.analyze(normal, segment.clauses(normal.select("doc_id", "text")), models)

    def taxonomy(self) -> DataFrame:
        return scan.categories(self.spark, self.categories)

    def formats(self) -> DataFrame:
        return documents.formats(self.spark)

    def register(self) -> None:
        """SQL functions of the same semantics: cf_fingerprint, cf_locate_quote, cf_parse_model_json, cf_extract_html."""
        from clauseflow.functions.modeljson import parse_udf
        from clauseflow.operators.verify import locate_udf
        from clauseflow.sources.html import extract

        for name, f in (("cf_fingerprint", normalize.fingerprint_udf), ("cf_locate_quote", locate_udf), ("cf_parse_model_json", parse_udf)):
            self.spark.udf.register(name, f)

        @F.pandas_udf("string")
        def extract_html(html: pd.Series) -> pd.Series:
            return html.map(lambda h: extract(h)["text"])

        self.spark.udf.register("cf_extract_html", extract_html)
