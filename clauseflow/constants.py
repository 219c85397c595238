"""Limits and formats that decide results."""

from __future__ import annotations

# Segmentation.
MIN_CLAUSE_CHARS, MAX_CLAUSES, TARGET_CHUNK_CHARS = 100, 300, 900
HEADING_CHARS, BARE_HEADING_CHARS, PREAMBLE_CHARS = 120, 40, 80
SHOWN_HEADING, SHOWN_SENTENCE = 80, 60
# Normalisation.
LONG_LINE, LEAST_PIECE = 600, 120
MAX_TEXT_CHARS = 400_000
# Scanning, verification, reports.
MATCH_CHARS, KEPT_MATCHES, SENTENCE_CHARS = 60, 3, 180
QUOTE_CHARS, PER_CLAUSE, WORDING = 400, 5, 6
FUZZY_CHARS, FINGERPRINT_CHARS = 6, 8
SCORE_SCALE, CALIBRATE_FROM = 70, 40
VERDICTS = ((20, "整体较为常规"), (45, "有需要注意的条款"), (70, "存在多项明显不利条款"), (100, "存在严重风险条款"))
MAX_NOTES, NOTE_FROM = 60, 20
MAX_INTERACTIONS = 5
BATCH_CHARS = 6000
# Retrieval and questions.
K1, B, HEADING_WEIGHT = 1.2, 0.75, 3
TOP_K, MAX_PASSAGE_CHARS, NEIGHBOURS = 8, 20_000, 1
WHOLE_CORPUS_CHARS, MAX_DOCUMENTS, QUESTION_CHARS = 500_000, 8, 500
EVIDENCE_CHARS, MAX_EVIDENCE = 6, 8
# History.
HISTORY_ENTRIES, HISTORY_TAGS = 12, 40

# What a category suggests to ask.
QUESTION_POOL = [
    ("auto_renewal", "会自动扣费吗？怎么取消？"),
    ("refund", "付了钱能退吗？"),
    ("data_sharing", "我的数据会被共享给谁？"),
    ("privacy_tracking", "平台会追踪我的行为吗？"),
    ("content_license", "我发的内容会被平台拿去用吗？"),
    ("account_termination", "账号被封了会怎样？"),
    ("arbitration", "发生争议要去哪里解决？"),
    ("unilateral_change", "平台能随便改协议吗？"),
    ("data_retention", "注销后我的数据还会留着吗？"),
    ("liability_disclaimer", "服务出问题平台负责吗？"),
]

# Other spellings of severities and tones.
SEVERITY_ALIASES = {
    "严重": "critical", "极高": "critical", "致命": "critical", "高危": "high", "高": "high", "较高": "high", "中": "medium", "中等": "medium",
    "一般": "medium", "低": "low", "较低": "low", "轻微": "low", "信息": "info", "提示": "info", "注意": "info", "无": "info",
}
TONES = ("favorable", "neutral", "unfavorable", "mixed")
TONE_ALIASES = {"有利": "favorable", "对用户有利": "favorable", "中性": "neutral", "中立": "neutral", "不利": "unfavorable", "对用户不利": "unfavorable", "喜忧参半": "mixed", "混合": "mixed"}

# Query parameters that don't tell pages apart.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "yclid",
    "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url", "spm", "scm", "_hsenc", "_hsmi", "vero_id", "pk_campaign", "pk_kwd", "mtm_campaign", "mtm_source",
]
PRIVATE_HOST = r"(?i)^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[?::1\]?$|\[?f[cd][0-9a-f][0-9a-f]:)"
