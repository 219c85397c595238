import pytest
from pyspark.sql import functions as F

from clauseflow import taxonomy as T
from clauseflow.operators import report, scan
from clauseflow.operators import segment as S

TEXT = "用户协议\n\n第一条 总则\n本协议由您与平台订立，平台有权随时单方面修改本协议内容。\n第二条 费用与自动续费\n会员到期后将自动续费。费用一经支付不予退还。"


@pytest.fixture(scope="module")
def docs(spark):
    para = "\n\n".join("本段落是一个没有编号的说明性文字，用于测试段落聚合切分。" * 4 for _ in range(12))
    many = "\n".join(f"{i + 1}. 条款标题\n{'正文' * (1 + i % 5)}" for i in range(350))
    return spark.createDataFrame([(1, TEXT), (2, para), (3, ""), (4, None), (5, "  \n "), (6, many), (7, "x" * 50_000)], "doc_id long, text string")


def test_offsets_hug_the_text(spark, docs):
    c = S.clauses(docs).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert c.where(F.substring(F.col("t"), F.col("start") + 1, F.col("chars")) != F.col("text")).count() == 0
    assert c.where((F.col("end") - F.col("start") != F.col("chars")) | (F.trim("text") != F.col("text"))).count() == 0


def test_structure_and_preamble(spark, docs):
    rows = S.clauses(docs.where("doc_id = 1")).orderBy("idx").collect()
    assert [(r["clause_id"], r["heading"], r["heading_rule"]) for r in rows] == [("c1", "第一条 总则", "cn-article"), ("c2", "第二条 费用与自动续费", "cn-article")]
    assert rows[0]["text"].startswith("用户协议")


def test_paragraphs_empty_and_most(spark, docs):
    n = {r["doc_id"]: r["count"] for r in S.clauses(docs).groupBy("doc_id").count().collect()}
    assert n == {1: 2, 2: 2, 6: 300, 7: 1}
    s = {r["doc_id"]: r["strategy"] for r in S.stats(docs).collect()}
    assert s == {1: "structure", 2: "paragraph", 3: "empty", 4: "empty", 5: "empty", 6: "structure", 7: "paragraph"}


def test_reduce_blocks_against_plain_search():
    blocks, at = [], 0
    for n in (5, 3, 3, 9, 1, 1, 7, 2):
        blocks.append({"start": at, "end": at + n, "rule": None, "line": ""})
        at += n + 1
    plain = [dict(b) for b in blocks]
    while len(plain) > 3:
        sizes = [plain[i]["end"] - plain[i]["start"] + plain[i + 1]["end"] - plain[i + 1]["start"] for i in range(len(plain) - 1)]
        i = sizes.index(min(sizes))
        plain[i]["end"] = plain[i + 1]["end"]
        del plain[i + 1]
    assert S.reduce_blocks(blocks, 3) == plain


def test_findings_quote_the_body_not_the_heading(spark, docs):
    f = scan.findings(S.clauses(docs.where("doc_id = 1"))).orderBy("rank").collect()
    assert [x["category"] for x in f] == ["unilateral_change", "auto_renewal", "refund"]
    assert f[1]["quote"] == "会员到期后将自动续费。" and f[2]["quote"] == "费用一经支付不予退还。"
    assert all(TEXT[x["start"] : x["end"]] == x["quote"] for x in f)


def test_every_category_has_a_clause(spark):
    from clauseflow.plans.seeded import CLAUSES

    c = spark.createDataFrame([(1, f"c{i}", i, h, b, 0) for i, (h, b) in enumerate(CLAUSES)], "doc_id long, clause_id string, idx int, heading string, text string, start int")
    assert {r[0] for r in scan.prescan(c).select("category").distinct().collect()} == {x[0] for x in T.CATEGORIES if x[6]}


def test_report_and_interactions(spark, docs):
    c = S.clauses(docs)
    f = scan.findings(c)
    r = {x["doc_id"]: x for x in report.reports(f, docs.select("doc_id", F.lit(2).alias("clause_count"), F.lit(9).alias("total_chars"))).collect()}
    assert len(r) == 7 and r[1]["n_findings"] == 3 and r[1]["risk_score"] == 39 and r[3]["risk_score"] == 0
    assert r[1]["verdict"] == "有需要注意的条款" and "未在约 9 字" in r[3]["summary"]
    x = report.interactions(f).collect()
    assert [(y["clause_ids"], y["title"]) for y in x] == [(["c2"], "自动续费 + 不予退款")]
    md = report.markdown(report.reports(f, docs.select("doc_id", F.lit(2).alias("clause_count"), F.lit(9).alias("total_chars"))), f, docs.select("doc_id", F.lit("T").alias("title"), F.lit(9).alias("chars"), F.lit(2).alias("clause_count"))).where("doc_id = 1").first()["markdown"]
    assert md.startswith("# 协议风险报告：T") and "### 3. [中] 退款与费用规则" in md


def test_spans_merge_only_where_they_overlap(spark):
    f = spark.createDataFrame([(1, "f1", 1, "low", 0, 10), (1, "f2", 2, "high", 5, 12), (1, "f3", 3, "low", 12, 20), (1, "f4", 4, "low", 7, 7)], "doc_id long, finding_id string, rank int, severity string, start int, end int")
    m = [(r["start"], r["end"], r["ids"], r["severity"]) for r in scan.merge_spans(f).orderBy("start").collect()]
    assert m == [(0, 12, ["f1", "f2"], "high"), (12, 20, ["f3"], "low")]
    html = report.highlighted(spark.createDataFrame([(1, "<" + "a" * 19), (2, "x&y")], "doc_id long, text string"), scan.merge_spans(f)).orderBy("doc_id").collect()
    assert html[0]["html"].startswith('<mark class="sev-high" data-ids="f1,f2">&lt;a') and html[1]["html"] == "x&amp;y"


def test_texts_are_normalised_twice_at_most_for_clauses_and_their_findings(spark, tmp_path):
    from clauseflow.operators import normalize

    spark.createDataFrame([(1, TEXT), (2, "x y\n" * 400)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    c = S.clauses(normalize.normalize_documents(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "text"))
    tones = report.clause_tones(c, scan.findings(c))
    assert {r["clause_id"] for r in tones.where("doc_id = 1").collect()} == {"c1", "c2"}
    tones.collect()
    plan = tones._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") <= 4  # two for a pass: texts that need Unicode's composed form, and the others


def test_gates_of_signals_lose_no_match(spark):
    import re

    for name, *_, patterns in T.CATEGORIES:
        for p, ic in patterns:
            assert scan.needed(p), (name, p)
    assert scan.needed("(?:ab|cd)+x?") == {"ab", "cd"} and scan.needed("a?b*") is None and scan.needed("(?i:ab)") is None and scan.needed(r"\Qa\E") is None
    assert re.search(scan.any_of(frozenset({"abc", "abd", "x"})), "zzabd") and not re.search(scan.any_of(frozenset({"abc", "abd", "x"})), "abe")
    own = [("k", "K", "g", "low", "", "", [("a?b*Q", False), ("[xy]{2}", True)])]
    c = spark.createDataFrame([(1, "c1", 0, "h", "..Q XY", 0), (2, "c1", 0, "h", "none", 0)], "doc_id long, clause_id string, idx int, heading string, text string, start int")
    assert [(r["doc_id"], r["matches"]) for r in scan.prescan(c, own).collect()] == [(1, ["Q", "XY"])]


def test_headings_by_the_line_below(spark):
    docs = spark.createDataFrame([(1, "  Scope \n" + "x" * 60 + "\nend.\n" + "y" * 90 + "\n 第一条 总则 \nb")], "doc_id long, text string")
    assert [(r["pos"], r["rule"]) for r in S.lines_of(docs).orderBy("pos").collect()] == [(0, "bare"), (1, None), (2, None), (3, None), (4, "cn-article"), (5, None)]
