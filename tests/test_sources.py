import io
import zipfile
import zlib

from pyspark.sql import functions as F

from clauseflow import providers
from clauseflow.engine import Engine
from clauseflow.sources import documents as D
from clauseflow.sources import html, pdf
from clauseflow.streaming import ingest

BODY = "".join(f"<p>Clause {i}: you agree, and we agree, that this text is long enough &amp; clear.</p>" for i in range(12))
PAGE = f"<html><head><title>Terms | Site</title></head><body><nav>menu</nav><div class='cookie'>cookies</div><div id='terms'><h1>User Terms</h1>{BODY}<table><tr><td>a</td><td>b</td></table><ul><li>one<li>two</ul></div><footer>foot</footer>"


def make_pdf(content: bytes, filters: bytes = b"/FlateDecode", extra: bytes = b"") -> bytes:
    s = zlib.compress(content) if filters == b"/FlateDecode" else content
    head = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F1 5 0 R>>>>>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n"
    return head + b"4 0 obj<</Length " + str(len(s)).encode() + b"/Filter" + filters + b">>stream\n" + s + b"\nendstream endobj\n5 0 obj<</Type/Font/Subtype/Type1" + extra + b">>endobj\n"


def test_html_main_content():
    r = html.extract(PAGE)
    assert r["strategy"] == "candidate-scoring" and r["title"] == "User Terms"
    assert "menu" not in r["text"] and "cookies" not in r["text"] and "foot" not in r["text"]
    assert "long enough & clear." in r["text"] and "a | b" in r["text"] and "one\ntwo" in r["text"]


def test_html_is_forgiving():
    assert html.extract("<p>a < b <b>c<p>d &unknown; &#x41;")["text"].replace("\n", "") == "a < b cd &unknown; A"
    assert html.extract("# Title\n\nplain") == {"text": "# Title\n\nplain", "title": "Title", "strategy": "passthrough", "warnings": []}
    assert html.extract(None)["text"] == "" and html.extract("<" * 5000)["text"]


def test_pdf():
    r = pdf.extract(make_pdf(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again)] TJ ET"))
    assert r["text"] == "Hello (PDF)\nWorld again" and len(r["pages"]) == 1
    assert pdf.extract(make_pdf(b"BT (abc) Tj ET".hex().encode() + b">", b"/ASCIIHexDecode"))["text"] == "abc"
    assert pdf.extract(make_pdf(b"BT /F1 9 Tf (A\x80) Tj ET", extra=b"/Encoding<</Differences[65/uni4F60 128/Euro]>>"))["text"].startswith("你")
    assert pdf.extract(b"%PDF-1.4 /Encrypt 5 0 R")["warnings"] == ["the file is encrypted"]
    assert pdf.extract(b"garbage")["warnings"] and pdf.extract(make_pdf(b"q Q"))["warnings"]


def test_cmap():
    m, w = pdf.parse_cmap(b"begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <4F60> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange")
    assert m == {1: "你", 2: "A", 3: "B"} and w == 2


def test_decode_and_json():
    assert D.decode("条款".encode("gbk"), "text/plain; charset=gb2312") == ("条款", "gbk")
    assert D.decode(b"\xff\xfe" + "条".encode("utf-16-le")) == ("条", "utf-16le")
    assert D.json_text('{"a": ["' + "long text " * 5 + '"], "b": "short"}')[0].startswith("long text")
    assert D.json_text("not json") == ("not json", None) and D.json_text("{}")[1]


def test_files_end_to_end(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>第一条 总则</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>a &amp; b</w:t></w:r></w:p></w:document>")
        f.writestr("docProps/core.xml", "<dc:title>T</dc:title>")
    for name, data in {"a.docx": z.getvalue(), "b.html": PAGE.encode(), "c.pdf": make_pdf(b"BT (x) Tj ET"), "d.txt": "纯文本".encode(), "e.json": b'{"k": 1}'}.items():
        (tmp_path / name).write_bytes(data)
    r = {x["filename"]: x["extracted"] for x in D.read_files(spark, str(tmp_path)).collect()}
    assert r["a.docx"]["text"] == "第一条 总则\n• a & b" and r["a.docx"]["title"] == "T"
    assert r["b.html"]["format"] == "html" and r["c.pdf"]["text"] == "x" and r["d.txt"]["text"] == "纯文本"
    assert r["e.json"]["warnings"] and D.extract_bytes(b"", "text")["warnings"] == ["empty file"]


def test_providers(spark):
    p = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, prompt string")

    def model(s: str) -> str:
        if s == "bad":
            raise TimeoutError("slow")
        return s.upper()

    r = {x["id"]: x for x in providers.call_model(p, model, attempts=2).collect()}
    assert r[1]["answer"] == "OK" and r[2]["answer"] is None and r[2]["tries"] == 2 and "slow" in r[2]["error"]
    assert "no network" in providers.fetch_urls(spark.createDataFrame([("http://x",)], "url string")).first()["error"]
    assert providers.first_that_works(lambda q: [], lambda q: [{"url": q}])("u") == [{"url": "u"}]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "2024-01-01 00:00:00", f"t{i}", "", "第一条 费用\n会员到期后将自动续费。") for i in range(1, 4)]
    src = spark.createDataFrame(rows, "seq long, at string, title string, url string, text string")
    src.write.json(str(tmp_path / "in"))
    items = ingest.items(spark, str(tmp_path / "in"))
    ingest.analyse(items, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").count().count() == 3
    assert ingest.latest(src, 2).first()["seq"] == 3 and ingest.latest(src, 3).count() == 0


def test_engine(spark):
    e = Engine(spark)
    a = e.analyze(spark.createDataFrame([(1, "第一条 费用\n会员到期后将自动续费。费用一经支付不予退还。"), (2, "")], "doc_id long, text string"))
    assert {r["doc_id"]: r["status"] for r in a.docs.collect()} == {1: "ok", 2: "EMPTY_TEXT"}
    assert a.findings.count() == 2 and e.markdown(a).count() == 2 and e.taxonomy().count() == 27
    assert e.ask(spark.createDataFrame([(1, "自动续费")], "question_id long, question string"), a.clauses).first()["answerable"]
    e.register()
    assert spark.sql("SELECT cf_fingerprint('Ａ b') AS f").first()["f"] == "ab"


def test_uploads(spark):
    p = spark.createDataFrame([(1, 1, "", "b"), (1, 0, "T", "a"), (1, 2, "U", "")], "upload_id long, pos int, title string, text string")
    assert tuple(D.join_uploads(p).first()) == (1, "a\n\nb", "T")


def test_entry_point(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert spark is not None and F is not None
