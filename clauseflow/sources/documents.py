"""Files of several formats to text: detection, decoding, and one dispatcher that never fails a row."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from clauseflow.session import share_package
from clauseflow.sources import html, pdf

# Formats and their extensions; other names of character sets.
FORMATS = [("text", "纯文本 / Markdown", [".txt", ".md", ".markdown", ".text", ".log"]), ("html", "网页 / HTML", [".html", ".htm", ".xhtml", ".mhtml", ".mht"]), ("pdf", "PDF 文档", [".pdf"]), ("docx", "Word 文档（.docx）", [".docx"]), ("json", "JSON", [".json"]), ("url", "网址抓取", [])]
CHARSETS = {"utf8": "utf-8", "gb2312": "gbk", "gb-2312": "gbk", "big5hkscs": "big5", "latin1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "utf-8", "us-ascii": "utf-8", "sjis": "shift_jis", "euc_jp": "euc-jp", "euckr": "euc-kr", "koi8r": "koi8-r", "windows1252": "windows-1252"}
EXTRACTED = StructType([StructField("text", StringType()), StructField("title", StringType()), StructField("format", StringType()), StructField("charset", StringType()), StructField("strategy", StringType()), StructField("pages", ArrayType(StringType())), StructField("warnings", ArrayType(StringType()))])


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "id string, label string, extensions array<string>")


def detect_format(content: Column, filename: Column, mime: Column) -> Column:
    """pdf, docx, zip, doc, html, json or text: by first bytes, extension, MIME type, then by what the text looks like."""
    ext = F.regexp_extract(F.lower(F.coalesce(filename, F.lit(""))), r"\.[a-z0-9]+$", 0)
    m = F.lower(F.coalesce(mime, F.lit("")))
    magic = F.hex(F.substring(content, 1, 4))
    inside = F.contains(content, F.encode(F.lit("word/document.xml"), "UTF-8"))
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"), r"^\s+", ""))
    body = F.decode(content, "ISO-8859-1")
    return (
        F.when(magic == "25504446", "pdf").when(magic == "D0CF11E0", "doc")
        .when(magic == "504B0304", F.when((ext == ".docx") | m.contains("wordprocessingml") | inside, F.lit("docx")).otherwise(F.lit("zip")))
        .when(ext.isin(".pdf", ".docx", ".doc"), F.substring(ext, 2, 9)).when(ext.isin(*FORMATS[1][2]), "html").when(ext == ".json", "json")
        .when(m.contains("pdf"), "pdf").when(m.contains("html"), "html").when(m.contains("json"), "json").when(m.contains("wordprocessingml"), "docx")
        .when(head.startswith("<!doctype html") | head.startswith("<html") | head.rlike(r"<body[\s>]"), "html")
        .when(head.rlike(r"^[\[{]") & F.try_parse_json(body).isNotNull(), "json").otherwise(F.lit("text"))
    )


def decode(data: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, character set): byte order mark, declaration, what the document says itself, UTF-8."""
    for mark, cs in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(cs, "replace"), cs.replace("16-", "16")
    head = data[:8192].decode("latin1")
    own = re.search(r"<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)", head, re.I) or re.search(r"<\?xml[^>]+encoding\s*=\s*[\"']([\w-]+)[\"']", head, re.I)
    declared = (m[1] if (m := re.search(r"charset\s*=\s*[\"']?([\w-]+)", declared, re.I)) else None if "/" in declared else declared) if declared else None
    for cs in (declared, own[1] if own else None, "utf-8"):
        if not cs:
            continue
        key = cs.strip().lower().strip("\"'")
        key = CHARSETS.get(key, key)
        try:
            text = data.decode(key, "replace")
        except LookupError:
            continue
        if key != "utf-8" or text.count("�") <= max(4, len(text) * 0.002):
            return text, key
    return data.decode("utf-8", "replace"), "utf-8"


def json_text(text: str) -> tuple[str, str | None]:
    """Long strings of a JSON document in their order, and a warning where there are none; other text as it is."""
    out: list[str] = []

    def walk(v, depth: int) -> None:
        if depth > 8:
            return
        if isinstance(v, str):
            s = v.strip()
            if len(s) >= 40 and re.search(r"[\s一-鿿]", s):
                out.append(s)
        elif isinstance(v, (list, dict)):
            for x in v.values() if isinstance(v, dict) else v:
                walk(x, depth + 1)

    try:
        walk(json.loads(text), 0)
    except (ValueError, RecursionError):
        return text, None
    return "\n\n".join(out), None if out else "JSON 中未找到足够长的文本字段。"


def docx_text(data: bytes) -> tuple[str, str]:
    """(text, title): paragraphs of the document, then of headers and footers; list items get a bullet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        parts = [n for n in ["word/document.xml"] if n in names] + sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
        texts = []
        for n in parts:
            paragraphs = []
            for p in re.findall(r"<w:p[ >].*?</w:p>", z.read(n).decode("utf-8", "replace"), re.S):
                runs = re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|<w:(tab|br|cr)\b", p, re.S)
                s = "".join("\t" if k == "tab" else "\n" if k else html.decode_entities(t) for t, k in runs).strip()
                paragraphs.append(("• " if "<w:numPr" in p and s else "") + s)
            texts.append("\n".join(paragraphs).strip())
        core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in names else ""
    title = re.search(r"<dc:title>(.*?)</dc:title>", core, re.S)
    return "\n\n".join(t for t in texts if t), html.decode_entities(title[1]).strip() if title else ""


def extract_bytes(data: bytes | None, fmt: str, mime: str | None = None) -> dict:
    out = {"text": "", "title": "", "format": fmt, "charset": None, "strategy": None, "pages": None, "warnings": []}
    if not data:
        return out | {"warnings": ["empty file"]}
    try:
        if fmt == "pdf":
            return out | pdf.extract(data)
        if fmt == "docx":
            text, title = docx_text(data)
            return out | {"text": text, "title": title}
        if fmt in ("zip", "doc"):
            return out | {"warnings": ["this format can't be read: save it as .docx, PDF or text"]}
        text, charset = decode(data, mime)
        out["charset"] = charset
        if fmt == "json":
            found, warning = json_text(text)
            return out | {"text": found, "warnings": [warning] if warning else []}
        if fmt == "html" or re.search(r"<(html|body|div|p)\b", text, re.I):
            got = html.extract(text)
            if fmt == "html" or len(got["text"]) > 0.3 * len(text):
                return out | got
        return out | {"text": text.strip()}
    except Exception as e:  # noqa: BLE001 - a file that can't be read is a warning in its row
        return out | {"warnings": [f"not readable: {type(e).__name__}"]}


def extract_files(files: DataFrame) -> DataFrame:
    """files (content, filename, mime and any other columns) with a struct `extracted`; content is dropped."""
    share_package(files.sparkSession)

    @F.pandas_udf(EXTRACTED)
    def run(content: pd.Series, fmt: pd.Series, mime: pd.Series) -> pd.DataFrame:
        rows = [extract_bytes(bytes(c) if c is not None else None, f, m) for c, f, m in zip(content, fmt, mime, strict=True)]
        return pd.DataFrame([[r[f.name] for f in EXTRACTED.fields] for r in rows], columns=EXTRACTED.names)

    fmt = detect_format(F.col("content"), F.col("filename"), F.col("mime"))
    return files.withColumn("extracted", run("content", fmt, F.coalesce("mime", F.lit("")))).drop("content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as path, filename, mime and extracted; Spark's file source passes over files of no length."""
    f = spark.read.format("binaryFile").load(path)
    return extract_files(f.select("path", "content", F.regexp_extract("path", "[^/]+$", 0).alias("filename"), F.lit(None).cast("string").alias("mime")))


def join_uploads(parts: DataFrame) -> DataFrame:
    """Several files of one upload (upload_id, pos, title, text) as one text in their order; the first title counts."""
    x = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return parts.groupBy("upload_id").agg(F.array_join(F.filter(F.transform(x, lambda p: p["text"]), lambda t: F.length(t) > 0), "\n\n").alias("text"), F.min_by("title", F.when(F.length("title") > 0, F.col("pos"))).alias("title"))
