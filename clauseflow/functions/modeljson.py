"""JSON as models write it: fenced, with trailing commas, raw newlines or curly quotes, or cut off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARSED = StructType([StructField("json", StringType()), StructField("level", StringType()), StructField("warning", StringType())])


def unfence(text: str) -> str:
    t = (text or "").removeprefix("\ufeff").strip()
    t = re.sub(r"^```[a-zA-Z0-9_-]*\s*", "", t)
    return re.sub(r"```\s*$", "", t).strip()


def balanced(text: str) -> str | None:
    """From the first bracket to the one that closes it, or to the end."""
    m = re.search(r"[{\[]", text)
    if not m:
        return None
    opening, closing, depth = m[0], "}" if m[0] == "{" else "]", 0
    for t in re.finditer(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]]', text[m.start() :], re.S):
        depth += (t[0] == opening) - (t[0] == closing)
        if depth == 0 and t[0] == closing:
            return text[m.start() : m.start() + t.end()]
    return text[m.start() :]


def repair(text: str) -> str:
    t = re.sub("[“”]", '"', text)
    t = re.sub("[‘’]", "'", t)
    t = re.sub(r"^\s*//.*$", "", t, flags=re.M)
    t = re.sub(r"/\*.*?\*/", "", t, flags=re.S)
    t = re.sub(r",(\s*[}\]])", r"\1", t)
    escapes = {"\n": "\\n", "\r": "", "\t": "\\t"}
    t = re.sub(r'"(?:\\.|[^"\\])*(?:"|\Z)', lambda m: re.sub(r"[\n\r\t]", lambda c: escapes[c[0]], m[0]), t, flags=re.S)
    return re.sub(r"'([^'\\]*)'(\s*:)", r'"\1"\2', t)


def salvage(text: str, key: str) -> list:
    """The complete objects of the array under a key."""
    m = re.search(rf'"{re.escape(key)}"[^\[]*\[', text)
    out, at = [], m.end() if m else len(text)
    while at < len(text):
        nxt = re.compile(r"[{\]]").search(text, at)
        if not nxt or nxt[0] == "]":
            break
        piece = balanced(text[nxt.start() :])
        if piece is None or not piece.endswith("}"):
            break
        try:
            out.append(json.loads(repair(piece)))
        except ValueError:
            pass
        at = nxt.start() + len(piece)
    return out


def parse(text: str | None, key: str | None = None) -> tuple[str | None, str, str | None]:
    """(JSON, how it was read, warning): plain, sliced, repaired, salvaged or failed."""
    t = unfence(text or "")
    if not t:
        return None, "failed", "模型返回为空"
    s = balanced(t)
    for level, candidate in (("plain", t), ("sliced", s), ("repaired", repair(s) if s else None)):
        if candidate:
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False), level, None
            except ValueError:
                continue
    items = salvage(s, key) if s and key else []
    if items:
        return json.dumps({key: items}, ensure_ascii=False), "salvaged", f"模型输出疑似被截断，已从「{key}」中恢复 {len(items)} 条完整记录。"
    return None, "failed", f"无法从模型输出中解析 JSON（前 200 字符：{t[:200]}）"


@F.pandas_udf(PARSED)
def parse_udf(text: pd.Series, key: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t, k or None) for t, k in zip(text, key, strict=True)], columns=PARSED.names)
