"""One query per operator or group of operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.functions import text as X
from clauseflow.functions.modeljson import parse_udf
from clauseflow.functions import display
from clauseflow.operators import ask, history, model_analysis, normalize, report, retrieve, scan, segment, verify, websearch
from clauseflow.plans.seeded import agreements
from clauseflow.session import share_package, stored
from clauseflow.sources import documents as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clauses_of(spark: SparkSession, sf_dir: str, step: int = 5, own: bool = True) -> DataFrame:
    """Normalised and segmented agreements, with or without the documents' own text behind them."""
    return segment.clauses(normalize.normalize_documents(agreements(spark, sf_dir, step, own)).select("doc_id", "text"))


def findings_of(spark: SparkSession, sf_dir: str, step: int = 5) -> DataFrame:
    return scan.findings(clauses_of(spark, sf_dir, step))


@query
def nrm_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.normalize_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "stats.input_chars", "stats.output_chars", "stats.removed_noise_lines", "stats.dehyphenated")


@query
def nrm_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = documents(spark, sf_dir).select("doc_id", F.split(X.break_long_lines(F.coalesce("text", F.lit(""))), "\n").alias("l"))
    return broken.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"))


@query
def nrm_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise lines of the documents with a page number and a row of figures put in front."""
    t = F.concat(F.lit("- 12 -\nPage 3 of 9\n共 4 页\n2024.01.02\n"), F.coalesce("text", F.lit("")))
    kept = F.filter(F.split(t, "\n"), lambda x: ~X.is_noise(x))
    return documents(spark, sf_dir).select("doc_id", (F.size(F.split(t, "\n")) - F.size(kept)).cast("long").alias("removed"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


@query
def nrm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreements(spark, sf_dir).select("doc_id", X.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query
def nrm_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.clean(F.col("text"), 400).alias("line"))


@query
def redact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("key sk-"), F.md5(F.col("doc_id").cast("string")), F.lit(" and "), F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).select("doc_id", F.md5(X.redact_keys(t)).alias("redacted_md5"))


@query
def tok_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts over all agreements."""
    return agreements(spark, sf_dir).select(F.explode(X.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def seg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.lines_of(agreements(spark, sf_dir))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.length("line").cast("long").alias("chars"), "rule")


@query
def seg_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clauses_of(spark, sf_dir)
    return c.select("doc_id", "clause_id", "heading", F.md5("text").alias("text_md5"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "heading_rule")


@query
def seg_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are set apart by blank lines: all go through paragraph grouping where they are long."""
    spaced = documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n").alias("text"))
    c = segment.clauses(spaced)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max("chars").cast("long").alias("longest"), F.sum("chars").alias("chars"))


@query
def seg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segment.stats(agreements(spark, sf_dir))
    return s.select("doc_id", "strategy", F.col("total_chars").cast("long").alias("total_chars"), F.explode_outer("heading_rules").alias("rule", "n"))


@query
def prescan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scan.prescan(clauses_of(spark, sf_dir))
    return h.select("doc_id", "clause_id", "category", "severity", F.array_join("matches", "|").alias("matches"), F.array_join(F.transform("match_indexes", lambda i: i.cast("string")), ",").alias("match_indexes"))


@query
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings_of(spark, sf_dir)
    return f.select("doc_id", "finding_id", "clause_id", "category", "severity", "quote", "title", "advice", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query
def findings_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.filter_findings(findings_of(spark, sf_dir), "high", contains="第三方").select("doc_id", "finding_id", "category")


@query
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scores(findings_of(spark, sf_dir), documents(spark, sf_dir)).select("doc_id", F.col("score").cast("long").alias("score"), "verdict")


@query
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_summary(findings_of(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "category", "severity", "count", "note")


@query
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(findings_of(spark, sf_dir))


@query
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.group_rollup(findings_of(spark, sf_dir))


@query
def clause_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clauses_of(spark, sf_dir)
    return report.clause_tones(c, scan.findings(c)).select("doc_id", "clause_id", "tone")


@query
def clause_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clauses_of(spark, sf_dir)
    return report.notes(c, scan.findings(c)).select("doc_id", "note_id", "clause_id", "plain", "tone")


@query
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.interactions(findings_of(spark, sf_dir)).select("doc_id", "interaction_id", F.array_join("clause_ids", "+").alias("clause_ids"), "severity", "title")


@query
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.suggestions(findings_of(spark, sf_dir)).select("doc_id", F.array_join("questions", "|").alias("questions"))


def _docs_for_report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = stored(normalize.normalize_documents(agreements(spark, sf_dir)).select("doc_id", "title", "text"))
    c = stored(segment.clauses(docs.select("doc_id", "text")))
    counts = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clause_count"))
    info = docs.select("doc_id", "title", F.length("text").alias("chars")).join(counts, "doc_id", "left").withColumn("clause_count", F.coalesce("clause_count", F.lit(0)))
    return scan.findings(c), info


@query
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, info = _docs_for_report(spark, sf_dir)
    r = report.reports(found, info.withColumnRenamed("chars", "total_chars"))
    return r.select(
        "doc_id", F.col("risk_score").cast("long").alias("risk_score"), "verdict", "summary", F.col("n_findings").cast("long").alias("n_findings"),
        F.array_join(F.transform("top_concerns", lambda c: F.concat_ws(":", c["clause_id"], c["title"], c["severity"])), "|").alias("top_concerns"), F.array_join("actions", "|").alias("actions"),
    )


@query
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, info = _docs_for_report(spark, sf_dir)
    return report.markdown(report.reports(found, info.withColumnRenamed("chars", "total_chars")), found, info).select("doc_id", "markdown")


@query
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scan.merge_spans(findings_of(spark, sf_dir))
    return m.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.array_join("ids", ",").alias("ids"), "severity")


@query
def highlight_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(normalize.normalize_documents(agreements(spark, sf_dir)).select("doc_id", "text"))
    spans = scan.merge_spans(scan.findings(segment.clauses(docs)), docs.select("doc_id", F.length("text").alias("length")))
    return report.highlighted(docs, spans).select("doc_id", F.md5("html").alias("html_md5"))

QUESTIONS = [(1, "付了钱能退吗？"), (2, "账号被封了会怎样？"), (3, "我的数据会被共享给谁？"), (4, "发生争议要去哪里解决？"), (5, "trial renewal non-refundable fees"), (6, "公司年会在哪办")]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


@query
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.question_terms(_questions(spark)).select("question_id", "term", F.col("n_terms").cast("long").alias("n_terms"))


@query
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.build_index(clauses_of(spark, sf_dir)).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.build_index(clauses_of(spark, sf_dir))
    return index.totals.crossJoin(retrieve.upper_median_idf(index.idf)).select("total", F.round("avg_len", 6).alias("avg_len"), F.round("median_idf", 6).alias("median_idf"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose ranking: in whole documents of invented prose no clause reaches the strict bound."""
    r = retrieve.ranked(retrieve.build_index(clauses_of(spark, sf_dir)), _questions(spark), strict=False)
    return r.where("rank <= 20").select("question_id", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score"), "matched")


@query
def bm25_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieve.scored(retrieve.build_index(clauses_of(spark, sf_dir)), _questions(spark), strict=False)
    return s.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 3).alias("best"), F.max("matched").alias("most"))


@query
def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search(retrieve.build_index(clauses_of(spark, sf_dir)), _questions(spark)).select("question_id", "pos", "doc_id", "clause_id", "score")


@query
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every first clause."""
    c = clauses_of(spark, sf_dir)
    return retrieve.neighbours(c.select("doc_id", "clause_id", "idx"), c.where("idx = 0").select("doc_id", "clause_id"), 2)


@query
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.budget_prefix(clauses_of(spark, sf_dir), 300).select("doc_id", "clause_id", F.length("text").cast("long").alias("chars"), "truncated")


@query
def rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses cut out of texts that have lost their second half."""
    docs = normalize.normalize_documents(agreements(spark, sf_dir)).select("doc_id", "text")
    half = docs.select("doc_id", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))
    r = retrieve.rehydrate(half, segment.clauses(docs).drop("text"))
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("lost").alias("lost"), F.sum(F.length("text")).alias("chars"))


@query
def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.batches(clauses_of(spark, sf_dir), 120).select("doc_id", "clause_id", F.col("batch").cast("long").alias("batch"))


@query
def kadane_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best run of line items by quantity around 25, per order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("double") - 25).alias("v")))).alias("x"))
    run = retrieve.best_run(F.transform("x", lambda x: x["v"]))
    return items.select("l_orderkey", run.alias("r")).select("l_orderkey", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("stop"), F.round("r.sum", 6).alias("total"))


def _raw_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings as a model would send them: as they are, with other marks, under a wrong clause, made up, empty, repeated."""
    whole = stored(segment.with_clauses(normalize.normalize_documents(agreements(spark, sf_dir)).select("doc_id", "text")))
    docs, c = whole.select("doc_id", "text"), segment.unfold(whole)
    f = scan.findings(c).select("doc_id", "rank", "clause_id", "category", "severity", "quote", "title", "explanation", "impact", "advice", "hidden", "wording")
    def form(n: int, q: Column, c: Column) -> Column:
        return F.struct(F.lit(n).alias("form"), q.alias("q"), c.alias("c"))

    q, own = F.col("quote"), F.col("clause_id")
    forms = F.array(form(0, q, own), form(1, F.translate(q, "，。；", ",.;"), own), form(2, q, F.lit("c999")), form(3, F.concat(F.lit("编造的引文内容"), q), own), form(4, F.lit(" "), own))
    raw = stored(f).select("*", F.explode(forms).alias("x")).withColumn("ord", F.col("rank") * 10 + F.col("x.form"))
    return raw.select("doc_id", "ord", F.col("x.c").alias("clause_id"), F.upper("severity").alias("severity"), "category", F.col("x.q").alias("quote"), "title", "explanation", "impact", "advice", "hidden", "wording"), c, docs


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, c, docs = _raw_findings(spark, sf_dir)
    return verify.verify_findings(raw.select("doc_id", "ord", "clause_id", "category", "severity", "quote"), c, docs, hugging=True)


@query
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verified(spark, sf_dir)
    return v.select("doc_id", "ord", "finding_id", "clause_id", "category", "severity", "quote", "start", "end", "match_type", "status")


@query
def quote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verification_counts(_verified(spark, sf_dir))


@query
def quote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark passages stand in documents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.length("text") > 0).select("item_id", F.col("text").alias("q"))
    d = documents(spark, sf_dir).select("doc_id", "text")
    # A document that holds a passage has its longest inner word; only such pairs are looked at.
    inner = F.filter(F.split("q", r"[ \n]"), lambda w, i: (i > 0) & (i < F.size(F.split("q", r"[ \n]")) - 1))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n]"))).alias("k"))
    pairs = words.join(b.select("item_id", key.alias("k")), "k").select("doc_id", "item_id")
    paired = pairs.join(d, "doc_id").join(b, "item_id").select("doc_id", "item_id", "text", "q")
    # One or two words have no inner one: they are looked for in every text.
    short = d.join(b.where(key.isNull()), F.contains("text", F.col("q"))).select("doc_id", "item_id", "text", "q")
    found = paired.unionByName(short).withColumn("at", F.instr("text", F.col("q"))).where("at > 0")
    return found.select("doc_id", "item_id", (F.col("at") - 1).cast("long").alias("start"))


@query
def quote_owner_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause that holds each finding's start, found by range."""
    c = clauses_of(spark, sf_dir)
    spans = scan.findings(c).select("doc_id", "finding_id", F.col("start").alias("pos"))
    return verify.owners(spans, c).select("doc_id", "finding_id", F.col("owner").alias("clause_id"))


@query
def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of headings."""
    return clauses_of(spark, sf_dir).select("doc_id", "clause_id", normalize.fingerprint_udf(F.col("heading")).alias("fp"))


@query
def severity_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of severities, categories and tones, by document number."""
    k = F.pmod("doc_id", F.lit(8)).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k + 1)
    sev, cat = pick("HIGH", "严重", "moderate", "min", "致命", "informational", "?", " low "), pick("arbitration", "Data Sharing", "自动续费 / 扣费", "data-sharing", "x", "", "Refund", "退款与费用规则")
    tone = pick("有利", "Neutral", "不利", "mixed", "?", "", "对用户不利", "UNFAVORABLE")
    return documents(spark, sf_dir).select("doc_id", X.normalize_severity(sev).alias("severity"), X.normalize_category(cat).alias("category"), X.normalize_tone(tone).alias("tone"))


@query
def history_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every agreement against a later version of it."""
    c = history.compare(findings_of(spark, sf_dir), findings_of(spark, sf_dir, 7))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), "category", "before", "after", "delta")


@query
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("saved_at"))
    return history.retain(e.groupBy("id", "saved_at").count().drop("count")).select("id", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"))


@query
def corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.lit("conversation").alias("kind")).distinct()
    merged = history.merge_corpus(c, documents(spark, sf_dir).select("doc_id", F.lit("document").alias("kind")))
    return merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(X.html_strip(F.coalesce("html", F.lit("")))).alias("text_md5"))


@query
def js_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and pages emptied to a mount point, by the signs of a shell."""
    h = pages(spark, sf_dir).select("page_id", F.explode(F.array(F.coalesce("html", F.lit("")), F.concat(F.lit("<html><body><div id='app'></div><script>window.__NUXT__={}</script>"), F.repeat(F.lit("<i></i>"), 150), F.lit("</body></html>")))).alias("html"))
    return h.select("page_id", F.array_join(X.shell_signals(F.col("html")), ",").alias("signals"), F.length(X.visible_text(F.col("html"))).cast("long").alias("visible"), X.is_js_shell(F.col("html"), F.lit("")).alias("shell"))


@query
def html_tail_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of stripped pages without repeats in the tail: the last quarter, five lines at least; lines under six characters stay."""
    from pyspark.sql import Window

    lines = pages(spark, sf_dir).select("page_id", F.posexplode(F.split(X.html_strip(F.coalesce("html", F.lit(""))), "\n")).alias("pos", "line"))
    n = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    before = F.row_number().over(Window.partitionBy("page_id", "line").orderBy("pos"))
    marked = lines.select("page_id", (F.col("pos") >= n - F.greatest(F.lit(5), F.ceil(n * F.lit(0.25)))).alias("tail"), before.alias("nth"), F.length("line").alias("chars"))
    drop = F.col("tail") & (F.col("nth") > 1) & (F.col("chars") >= 6)
    return marked.groupBy("page_id").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"))


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.regexp_replace(F.coalesce("url", F.lit("")), "^https?://", ""), F.lit("　"))
    return pages(spark, sf_dir).select("page_id", X.repair_url(raw).alias("url"))


@query
def url_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.element_at(F.array(*map(F.lit, ("127.0.0.1", "10.1.2.3", "172.20.0.9", "172.32.0.9", "localhost", "printer.local", "example.com", "192.168.1.1"))), F.pmod("page_id", F.lit(8)).cast("int") + 1)
    u = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("ftp://")).otherwise(F.lit("http://")), host, F.lit("/x"))
    return pages(spark, sf_dir).select("page_id", X.is_private_url(u).alias("private"), X.is_fetchable(u).alias("fetchable"))


@query
def url_canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each canonical URL."""
    keyed = pages(spark, sf_dir).where(F.col("url").isNotNull()).select("page_id", X.url_key(F.col("url")).alias("key"))
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query
def ingest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest item after sequence number 10, as a cursor read sees it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.where("event_id > 10").agg(F.max_by(F.struct("event_id", "event_type", "user_id"), "event_id").alias("x")).select("x.*")


@query
def daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages(spark, sf_dir).select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), F.lit("page.html").alias("filename"), F.lit("text/html").alias("mime"))
    x = sources.extract_files(files)
    return x.select("page_id", "extracted.title", "extracted.strategy", F.length("extracted.text").alias("chars"), F.md5("extracted.text").alias("text_md5"))


@query
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct("doc_id", F.struct(F.array(F.struct("text")).alias("parts")).alias("body")))
    x = sources.extract_files(documents(spark, sf_dir).select("doc_id", F.encode(body, "UTF-8").alias("content"), F.lit("d.json").alias("filename"), F.lit(None).cast("string").alias("mime")))
    return x.select("doc_id", F.md5("extracted.text").alias("text_md5"))


@query
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of pages under other names."""
    k = F.pmod("page_id", F.lit(5)).cast("int") + 1
    name = F.element_at(F.array(*map(F.lit, ("a.pdf", "b.html", "c", "d.json", "e.txt"))), k)
    content = F.when(F.col("page_id") % 7 == 0, F.encode(F.lit("%PDF-1.4 x"), "UTF-8")).otherwise(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return pages(spark, sf_dir).select("page_id", sources.detect_format(content, name, F.lit("")).alias("format"))


@query
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a model may send them: fenced, with a trailing comma, cut off, or without JSON."""
    share_package(spark)
    k = F.pmod("doc_id", F.lit(4)).cast("int") + 1
    form = F.element_at(F.array(F.lit('```json\n{"findings": [{"a": 1}]}\n```'), F.lit('text {"findings": [{"a": 1},],} more'), F.lit('{"findings": [{"a": 1}, {"a": '), F.lit("no json")), k)
    return documents(spark, sf_dir).select("doc_id", parse_udf(form, F.lit("findings")).alias("p")).select("doc_id", "p.json", "p.level")


@query
def conversations_qna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers to the users' turns from the agreements."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' AND text IS NOT NULL")
    questions = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    found = retrieve.search(retrieve.build_index(clauses_of(spark, sf_dir)), questions)
    return ask.extractive(found, questions).select("question_id", "answerable", "confidence", F.size("evidence").alias("n_evidence"))


@query
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events as they are shown: count, time, size, colour of a score, progress of a stage."""
    n = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", (n * 7919).alias("number"), F.pmod(n * 1373, F.lit(200_000)).alias("ms"), F.pmod(n * 104_729, F.lit(5_000_000)).alias("bytes"), F.pmod(n, F.lit(101)).alias("score"))
    stage = F.element_at(F.array(*map(F.lit, (*display.STAGES, "?"))), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return e.select("event_id", display.number(F.col("number")).alias("number"), display.duration(F.col("ms")).alias("duration"), display.size(F.col("bytes")).alias("size"), display.moment(F.col("ts")).alias("moment"), display.score_colour(F.col("score")).alias("colour"), F.round(display.progress(stage, F.col("score"), F.lit(100)), 6).alias("progress"))


def _result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of both engines whose hits are the pages' addresses behind redirects, with repeats, adverts and dead links."""
    p = pages(spark, sf_dir).where(F.col("url").isNotNull())
    go = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=1"))
    token = F.regexp_replace(F.translate(F.base64(F.encode("url", "UTF-8")), "+/", "-_"), r"[=\r\n]", "")
    ck = F.concat(F.lit("https://www.bing.com/ck/a?x=1&amp;u=a1"), token)
    duck = F.concat(F.lit('<div class="result result--ad"><a class="result__a" href="https://ad.example.com/">Ad</a></div><div class="result"><h2><a class="result__a" href="'), go, F.lit('">Page <b>'), F.col("page_id").cast("string"), F.lit('</b></a></h2><a class="result__snippet">Terms &amp; <b>rules</b></a></div><div class="web-result"><a class="result__a" href="'), F.col("url"), F.lit('">Again</a></div><div class="result"><a class="result__a" href="javascript:x()">No</a></div>'))
    bing = F.concat(F.lit('<ol><li class="b_algo"><h2><a href="'), ck, F.lit('">Page '), F.col("page_id").cast("string"), F.lit('</a></h2><p>Terms &amp; rules</p></li><li class="b_algo"><h2><a href="/search?q=2">Next</a></h2></li><li class="b_algo"><h2><a href="https://empty.example.com/"></a></h2></li></ol>'))
    odd = F.col("page_id") % 2 == 1
    return p.select(F.col("page_id").alias("query_id"), F.when(odd, F.lit("bing")).otherwise(F.lit("duckduckgo")).alias("engine"), F.when(odd, bing).otherwise(duck).alias("html"))


@query
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results read from result pages, and the block of text they make."""
    r = websearch.results(websearch.normalize_hits(websearch.read_results(_result_pages(spark, sf_dir))))
    return r.select("query_id", F.size("results").cast("long").alias("n"), F.col("results")[0]["url"].alias("url"), "repeated", "invalid", "untitled", websearch.block(F.col("results"), 4000).alias("block"))


@query
def clause_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model_analysis.clause_index(clauses_of(spark, sf_dir))
    return c.select("doc_id", "clause_id", "heading", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.col("chars").cast("long").alias("chars"), "heading_rule")


@query
def clause_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = model_analysis.hints(scan.prescan(clauses_of(spark, sf_dir)))
    return h.select("doc_id", "clause_id", F.array_join("hints", "、").alias("hints"))


@query
def ingest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents would send with their first 400 characters selected; whether they can be analysed; a stable id; a slim text."""
    d = documents(spark, sf_dir)
    sent = display.ingest_text(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 400)), F.col("text"))
    text, cut = display.slim(F.col("text"), 1000)
    return d.select("doc_id", F.md5(sent).alias("sent_md5"), display.analysable(F.col("text")).alias("analysable"), display.stable_id(F.col("doc_id"), F.col("lang")).alias("id"), F.length(text).cast("long").alias("slim_chars"), cut.alias("truncated"))


def _offline_model(prompt: str) -> str:
    """Stands in for a model: a finding for every clause that speaks of refunds, or a report with a score."""
    import json
    import re

    if prompt.startswith("协议标题"):
        return json.dumps({"riskScore": 30 + prompt.count('"clauseId"') % 50, "verdict": "", "summary": "offline"})
    found = [{"clauseId": m[1], "category": "refund", "severity": "high", "quote": m[2][:30], "title": "退款", "explanation": "x", "impact": "", "advice": ""} for m in re.finditer(r"<<<(\w+)>>> [^\n]*\n([^\n]*退[^\n]*)", prompt)]
    return "```json\n" + json.dumps({"findings": found}, ensure_ascii=False) + "\n```"


@query
def model_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, prompts, answers, checks and reports of every agreement, with a model that works offline."""
    normal = normalize.normalize_documents(agreements(spark, sf_dir)).select("doc_id", "title", "text")
    a = model_analysis.analyze(normal, segment.clauses(normal.select("doc_id", "text")), [_offline_model], parallel=8)
    return a.reports.select("doc_id", "risk_score", "verdict", "n_findings", "mode", "batches", "failed", "tokens", F.size("warnings").alias("n_warnings"))
