"""Result pages, model calls and reports, display formats; deep HTML and updated PDF objects."""

import json
import zlib

from pyspark.sql import functions as F

from clauseflow import providers
from clauseflow.functions import display
from clauseflow.operators import history, model_analysis, segment, websearch
from clauseflow.sources.html import extract
from clauseflow.sources.pdf import Document

DUCK = """<div class="result result--ad"><a class="result__a" href="https://ad.example/">Ad</a></div>
<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fone.example%2Ftos%3Futm_source%3Dx&amp;rut=1">One &amp; <b>only</b></a><a class="result__snippet">The <b>terms</b></a></div>
<div class="web-result"><a class="result__a" href="https://one.example/tos/">Again</a></div><div class="result"><a class="result__a" href="mailto:x@y">Mail</a></div>
<div class="result"><a class="result__a" href="https://two.example/"><!-- no title --></a></div>"""
BING = """<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?!&amp;u=a1aHR0cHM6Ly90aHJlZS5leGFtcGxlL3A&amp;ntb=1">Three</a></h2><p>Rules</p></li>
<li class="b_algo"><h2><a href="/search?q=next">Next</a></h2></li></ol>"""


def test_result_pages(spark):
    pages = spark.createDataFrame([(1, "duckduckgo", DUCK), (2, "bing", BING), (3, "bing", "<p>unusual traffic</p>" + BING), (4, "duckduckgo", None), (5, "duckduckgo", "<a class='result-link' href='https://f.example/'>F</a>")], "query_id long, engine string, html string")
    n = websearch.normalize_hits(websearch.read_results(pages))
    assert [(r["query_id"], r["status"]) for r in n.orderBy("query_id", "ord").collect()] == [(1, "kept"), (1, "repeated"), (1, "invalid"), (1, "untitled"), (2, "kept"), (2, "invalid"), (5, "kept")]
    got = {r["query_id"]: r for r in websearch.results(n).collect()}
    assert [tuple(x) for x in got[1]["results"]] == [("One & only", "https://one.example/tos?utm_source=x", "The terms")]
    assert got[2]["results"][0]["url"] == "https://three.example/p" and (got[1]["repeated"], got[1]["invalid"], got[1]["untitled"]) == (1, 1, 1)
    assert websearch.results(n.limit(0)).count() == 0


def test_search_block(spark):
    many = [("T", f"https://x.example/{i}", "s" * 50) for i in range(9)] + [("", "", "lost"), (None, "https://y.example/", None)]
    d = spark.createDataFrame([(many,), ([],)], "r array<struct<title:string,url:string,snippet:string>>")
    full, none = (r[0] for r in d.select(websearch.block(F.col("r"), 4000)).collect())
    assert full.startswith("[1] T\n    https://x.example/0\n    sss") and full.endswith("[10] (无标题)\n    https://y.example/") and none == ""
    cut = d.select(websearch.block(F.col("r"), 200)).first()[0]
    assert len(cut) <= 200 and cut.endswith("…（内容已截断：共 10 条结果，仅显示前 200 字符）")


def test_calls_are_made_again():
    waits, state = [], {"n": 0}

    def model(prompt):
        state["n"] += 1
        if state["n"] == 1:
            raise providers.CallError(503)
        return "no json" if providers.REPAIR_TURN not in prompt else "{}"

    assert providers.ask(model, "p", as_json=True, wait=waits.append) == ("{}", None, 3) and waits == [700]

    def refused(prompt):
        raise providers.CallError(401)

    assert providers.ask(refused, "p", wait=waits.append)[1:] == ("HTTP 401: 需要登录后才能访问", 1)


TERMS = "用户协议\n\n第一条 费用\n费用一经支付，概不退款，请您谨慎购买本服务。\n\n第二条 账号\n我们有权随时终止您的账号，且不承担任何责任。\n\n第三条 其他\n其他事项由双方另行协商并以书面形式确认为准。"


def _docs(spark):
    docs = spark.createDataFrame([(1, "T", TERMS), (2, "U", TERMS)], "doc_id long, title string, text string")
    return docs, segment.clauses(docs.select("doc_id", "text"))


def test_model_analysis(spark):
    docs, clauses = _docs(spark)

    def model(prompt):
        if prompt.startswith("协议标题"):
            return json.dumps({"riskScore": 50, "verdict": "v"})
        return json.dumps({"findings": [{"clauseId": "c2", "category": "refund", "severity": "HIGH", "quote": "概不退款", "title": "t"}, {"clauseId": "c2", "category": "refund", "severity": "low", "quote": "编造的引文", "title": "t"}]})

    a = model_analysis.analyze(docs, clauses, [model])
    assert {(r["doc_id"], r["quote"], r["severity"], r["detected_by"]) for r in a.findings.collect()} == {(1, "概不退款", "high", "model"), (2, "概不退款", "high", "model")}
    r = a.reports.where("doc_id = 1").first()
    assert (r["mode"], r["verdict"], r["n_findings"], r["failed"]) == ("model", "v", 1, 0) and r["tokens"] > 0


def test_model_analysis_without_findings(spark):
    docs, clauses = _docs(spark)
    quiet = model_analysis.analyze(docs, clauses, [lambda p: '{"findings": []}'])
    assert {(x["risk_score"], x["verdict"]) for x in quiet.reports.collect()} == {(8, "未发现明显风险条款")}


def test_outcome_of_batches(spark):
    a = spark.createDataFrame([(1, 0, None, 5), (1, 1, "e2", 6), (1, 2, "e1", 7), (1, 3, "e2", 1), (2, 0, "e", 1), (3, 0, None, 2)], "doc_id long, batch int, error string, tokens long")
    got = {r["doc_id"]: (r["mode"], r["tokens"], r["warnings"]) for r in model_analysis.batch_outcome(a).collect()}
    assert got == {1: ("partial", 19, ["e2", "e1"]), 2: ("heuristic", 1, ["e"]), 3: ("model", 2, [])}


def test_prompts_name_hints(spark):
    docs, clauses = _docs(spark)
    from clauseflow.operators import scan

    p = model_analysis.map_prompts(clauses, scan.prescan(clauses)).where("doc_id = 1").collect()
    assert len(p) == 1 and p[0]["prompt"].startswith("共 ") and "<<<c2>>> " in p[0]["prompt"] and "[本地规则预扫描提示]" in p[0]["prompt"]


def test_urls_are_rendered_where_short(spark):
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("http://c",)], "url string")
    long = "<html><body><p>" + "Terms of this service are long enough to read. " * 20 + "</p></body></html>"

    def fetch(u):
        if u == "http://c":
            raise ConnectionError("down")
        return (200, "text/html", (long if u == "http://a" else "<html><body><p>short text</p></body></html>").encode())

    got = {r["url"]: r for r in providers.extract_urls(urls, fetch, lambda u: (200, "text/html", long.encode())).collect()}
    assert (got["http://a"]["source"], got["http://b"]["source"], got["http://b"]["enough"]) == ("fetched", "rendered", True)
    assert {r["url"]: r["enough"] for r in providers.extract_urls(urls, fetch).collect()} == {"http://a": True, "http://b": False, "http://c": False}


def test_history_delete_and_clear(spark, tmp_path):
    row = lambda i: (i, None, "t", 1, "v", 0, {}, "m", 1, 1, [])
    history.save(spark.createDataFrame([row("a"), row("b")], history.ENTRY), str(tmp_path / "h"))
    history.delete(spark, str(tmp_path / "h"), ["a"], str(tmp_path / "g"))
    assert [r["id"] for r in history.latest(spark, str(tmp_path / "g")).collect()] == ["b"]
    history.clear(spark, str(tmp_path / "g"))
    assert history.latest(spark, str(tmp_path / "g")).count() == 0


def test_formats(spark):
    d = spark.createDataFrame([(1234567, 950, 1536), (None, 61_500, 2_500_000), (0, 0, 0)], "n long, ms long, b long")
    got = [tuple(r) for r in d.select(display.number(F.col("n")), display.duration(F.col("ms")), display.size(F.col("b"))).collect()]
    assert got == [("1,234,567", "950 毫秒", "1.5 KB"), ("0", "1 分 2 秒", "2.38 MB"), ("0", "—", "0 B")]
    assert spark.range(1).select(display.as_array(F.lit(None).cast("int")), display.as_array(F.lit(3))).first()[:] == ([], [3])


def test_deep_html():
    page = "<html><body><main>" + "<div>" * 5000 + "<p>" + "Terms of service apply to every user. " * 30 + "</p>" + "</div>" * 5000 + "</main></body></html>"
    assert "Terms of service apply" in extract(page)["text"]


def _object_stream(number: int, value: bytes) -> bytes:
    body = b"7 0 " + value
    data = zlib.compress(body)
    return b"%d 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (number, len(data), data)


def test_newest_object_wins():
    old, new, direct = _object_stream(10, b"(old)"), _object_stream(11, b"(new)"), b"7 0 obj\n(direct)\nendobj\n"
    for parts, want in (((old, new), b"new"), ((direct, new), b"new"), ((old, direct), b"direct")):
        got = Document(b"%PDF-1.5\n" + b"".join(parts)).objects[7]
        assert got in (want, want.decode()), (want, got)
