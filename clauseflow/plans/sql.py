"""The same queries as DuckDB SQL, written as windows, unnests and list functions."""

from __future__ import annotations

from clauseflow import constants as K
from clauseflow import taxonomy as T
from clauseflow.functions.text import CJK, FULL, HALF, NOISE, SPACES, WS, ZERO_WIDTH
from clauseflow.operators.segment import HEADING_RULES, SENTENCE_END
from clauseflow.plans.seeded import agreements_sql

SQL: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    """A pattern as a literal; RE2 writes code points as \\x{...}, the characters themselves work in both."""
    import re

    return lit(re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), p))


def rep(c: str, p: str, to: str = "''") -> str:
    return f"regexp_replace({c}, {rx(p)}, {to}, 'g')"


def trim(c: str) -> str:
    return rep(c, rf"^[{WS}]+|[{WS}]+$")


def blank(c: str) -> str:
    return f"NOT regexp_matches({c}, {rx(rf'[^{WS}]')})"


NL = "chr(10)"


def broken(t: str) -> str:
    cut = rep("l", rf"([^\n]{{{K.LEAST_PIECE - 1},}}?[。！？；!?;])", r"'\1' || chr(10)")
    return f"array_to_string(list_transform(string_split({t}, {NL}), lambda l: CASE WHEN length(l) > {K.LONG_LINE} THEN rtrim({cut}, {NL}) ELSE l END), {NL})"


def noisy(l: str) -> str:
    return f"(NOT ({blank(l)}) AND ({' OR '.join(f'regexp_matches({l}, {rx(p)})' for p in NOISE)}))"


def normalized(table: str, extra: str = "") -> str:
    """CTEs n0..norm: doc_id, text, counts of a table with doc_id and text."""
    unified = rep(rep(f"translate({rep(rep('coalesce(nfc_normalize(text), chr(0))', chr(92) + 'r' + chr(92) + 'n?', 'chr(10)'), f'[{ZERO_WIDTH}{chr(0xAD)}]')}, {lit(FULL)}, {lit(HALF)})", f"[{SPACES}\\t]", "' '"), "[ ]+(\\n|$)", r"'\1'")
    unified = unified.replace("coalesce(nfc_normalize(text), chr(0))", "coalesce(nfc_normalize(text), '')")
    return f"""
n1 AS (SELECT doc_id, text AS raw, {unified} AS u {extra} FROM ({table})),
n2 AS (SELECT *, {rep('u', r'([A-Za-z])-\n([a-z])', "'" + chr(92) + "1" + chr(92) + "2'")} AS j FROM n1),
n3 AS (SELECT *, {broken('j')} AS b FROM n2),
n4 AS (SELECT *, list_filter(string_split(b, {NL}), lambda l: NOT {noisy('l')}) AS kept, len(string_split(b, {NL})) AS n_lines FROM n3),
norm AS (SELECT *, {trim(rep(rep(f'array_to_string(kept, {NL})', '[ ]{2,}', "' '"), chr(92) + 'n{3,}', 'chr(10) || chr(10)'))} AS text FROM n4)"""


NORM = normalized(agreements_sql(), ", title")


def rule_case(t: str, n: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, {rx(p)}) THEN '{name}'" for name, p in HEADING_RULES)
    bare = f"{t} <> '' AND length({t}) <= {K.BARE_HEADING_CHARS} AND NOT regexp_matches({t}, {rx(SENTENCE_END)}) AND length({n}) > length({t}) * 1.6 AND length({n}) > {K.BARE_HEADING_CHARS}"
    return f"coalesce(CASE WHEN {t} = '' OR length({t}) > {K.HEADING_CHARS} THEN NULL {whens} END, CASE WHEN {bare} THEN 'bare' END)"


def lines(table: str) -> str:
    """CTE lines over a table with doc_id and text."""
    return f"""
l0 AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, unnest(range(0, len(string_split(text, {NL})))) AS pos FROM {table}),
l1 AS (SELECT *, {trim('line')} AS t, {trim("coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '')")} AS nx,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l0),
lines AS (SELECT *, {rule_case('t', 'nx')} AS rule FROM l1)"""


def clause_ctes(table: str = "norm") -> str:
    """CTEs up to clauses, for texts whose first block has a heading or that have none: doc_id, clause_id, idx, heading, text, start, stop, rule."""
    return f"""{lines(table)},
b0 AS (SELECT *, count(rule) OVER (PARTITION BY doc_id ORDER BY pos) AS blk FROM lines),
b1 AS (SELECT doc_id, blk, min(start) AS s, max(start + length(line)) AS e, arg_min(rule, pos) FILTER (TRUE) AS r0, min(pos) AS p0, bool_or(NOT ({blank('line')})) AS solid FROM b0 GROUP BY doc_id, blk),
b2 AS (SELECT b1.doc_id, s, e, b0.rule, b0.t AS line FROM b1 JOIN b0 ON b0.doc_id = b1.doc_id AND b0.pos = b1.p0 WHERE solid),
b3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS rn, coalesce(rule, 'bare') = 'bare' AND e - s < {K.MIN_CLAUSE_CHARS} AS weak FROM b2),
b4 AS (SELECT *, sum(CASE WHEN rn = 1 OR NOT weak THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM b3),
b5 AS (SELECT doc_id, run, min(s) AS s, max(e) AS e, min(rn) AS first FROM b4 GROUP BY doc_id, run),
b6 AS (SELECT b5.doc_id, b5.run, b5.s, b5.e, b4.rule, b4.line FROM b5 JOIN b4 ON b4.doc_id = b5.doc_id AND b4.rn = b5.first),
b7 AS (SELECT *, bool_or(run = 1 AND rule IS NULL AND e - s < {K.PREAMBLE_CHARS}) OVER (PARTITION BY doc_id) AND max(run) OVER (PARTITION BY doc_id) > 1 AS pre FROM b6),
b8 AS (SELECT *, CASE WHEN pre THEN greatest(run, 2) ELSE run END AS g FROM b7),
b9 AS (SELECT doc_id, g, min(s) AS s, max(e) AS e, max(run) AS lastrun FROM b8 GROUP BY doc_id, g),
b10 AS (SELECT b9.doc_id, b9.s, b9.e, b8.rule, b8.line, row_number() OVER (PARTITION BY b9.doc_id ORDER BY b9.s) AS nth FROM b9 JOIN b8 ON b8.doc_id = b9.doc_id AND b8.run = b9.lastrun),
c0 AS (SELECT b10.*, substr(n.text, s + 1, e - s) AS raw FROM b10 JOIN {table} n USING (doc_id)),
c1 AS (SELECT *, {trim('raw')} AS body, s + length(raw) - length({rep('raw', rf'^[{WS}]+')}) AS "at" FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx,
  CASE WHEN rule IS NOT NULL THEN CASE WHEN length(line) > {K.SHOWN_HEADING} THEN substr(line, 1, {K.SHOWN_HEADING}) || '…' ELSE line END
  ELSE CASE WHEN length(regexp_extract(line, '^[^。！？.!?]*[。！？.!?]?')) > {K.SHOWN_SENTENCE} THEN substr(line, 1, {K.SHOWN_SENTENCE}) || '…' ELSE regexp_extract(line, '^[^。！？.!?]*[。！？.!?]?') END END AS h FROM c1 WHERE body <> ''),
clauses AS (SELECT doc_id, 'c' || (idx + 1) AS clause_id, idx, CASE WHEN h = '' THEN '第 ' || nth || ' 段' ELSE h END AS heading, body AS text, "at" AS start, "at" + length(body) AS stop, rule FROM c2)"""


CLAUSES = f"WITH {NORM}, {clause_ctes()}"

_SEV = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(T.SEVERITIES)) + " END"
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in T.SEVERITY_WEIGHTS.items()) + " END"


def hit_ctes() -> str:
    """CTE hits: one row per clause and category with a match."""
    parts = []
    for pos, (name, label, grp, base, what, _, patterns) in enumerate(T.CATEGORIES):
        if patterns:
            firsts = ", ".join(f"regexp_extract(text, {rx(('(?i)' if ic else '') + p)})" for p, ic in patterns)
            parts.append(f"SELECT doc_id, clause_id, idx, text, start, {pos} AS cat_pos, '{name}' AS category, '{base}' AS severity, {lit(label)} AS title, {lit(grp)} AS grp, {lit(what[:60])} AS note, {lit(T.ADVICE[name])} AS advice, {lit(what)} AS explanation, list_filter([{firsts}], lambda m: m <> '') AS ms FROM clauses")
    return "h0 AS (" + " UNION ALL ".join(parts) + f"), hits AS (SELECT * EXCLUDE (ms), ms[1:{K.KEPT_MATCHES}] AS ms FROM h0 WHERE len(ms) > 0)"


def finding_ctes() -> str:
    left = "regexp_extract(substr(text, 1, i + 1), '[^。！？；\n]*$')"
    right = "regexp_extract(substr(text, scan + 1), '^[^。！？；\n]*[。！？；\n]?')"
    return f"""{hit_ctes()},
f0 AS (SELECT *, substr(ms[1], 1, {K.MATCH_CHARS}) AS m, instr(text, ms[1]) - 1 AS i0, instr(text, {NL}) - 1 AS nl FROM hits),
f1 AS (SELECT *, CASE WHEN nl >= 0 AND i0 < nl AND instr(substr(text, nl + 2), m) > 0 THEN instr(substr(text, nl + 2), m) + nl ELSE i0 END AS i FROM f0),
f2 AS (SELECT *, i + 1 - length({left}) AS s, least(i + greatest(length(m), 1), length(text)) AS scan FROM f1),
f3 AS (SELECT *, substr(text, s + 1, scan + length({right}) - s) AS raw FROM f2),
f4 AS (SELECT *, {trim('raw')} AS q, s + length(raw) - length({rep('raw', rf'^[{WS}]+')}) AS qa FROM f3),
f5 AS (SELECT *, CASE WHEN length(q) > {K.SENTENCE_CHARS} AND i - qa > 0 AND i - qa + length(m) > {K.SENTENCE_CHARS} THEN greatest(i - qa - 20, 0) ELSE 0 END AS skip FROM f4),
f6 AS (SELECT *, {trim(f'substr(q, skip + 1, {K.SENTENCE_CHARS})')} AS quote, start + qa + skip AS fs FROM f5),
found AS (SELECT *, fs + length(quote) AS fe, row_number() OVER (PARTITION BY doc_id ORDER BY {_SEV}, fs, idx, cat_pos) AS rank FROM f6)"""


FOUND = f"{CLAUSES}, {finding_ctes()}"


def verdict(c: str) -> str:
    return f"CASE WHEN {c} <= 20 THEN '{K.VERDICTS[0][1]}' WHEN {c} <= 45 THEN '{K.VERDICTS[1][1]}' WHEN {c} <= 70 THEN '{K.VERDICTS[2][1]}' ELSE '{K.VERDICTS[3][1]}' END"


SQL["nrm_normalize"] = f"""WITH {normalized('SELECT doc_id, text FROM documents')}
SELECT doc_id, md5(text) AS text_md5, length(coalesce(raw, ''))::INT AS input_chars, length(text)::INT AS output_chars, (n_lines - len(kept))::INT AS removed_noise_lines, j <> u AS dehyphenated FROM norm"""
SQL["nrm_long_lines"] = f"""SELECT doc_id, len(l)::BIGINT AS n_lines, list_max(list_transform(l, lambda x: length(x)))::BIGINT AS longest
FROM (SELECT doc_id, string_split({broken("coalesce(text, '')")}, {NL}) AS l FROM documents)"""
SQL["nrm_noise_lines"] = f"""WITH d AS (SELECT doc_id, string_split('- 12 -' || chr(10) || 'Page 3 of 9' || chr(10) || '共 4 页' || chr(10) || '2024.01.02' || chr(10) || coalesce(text, ''), {NL}) AS l FROM documents),
k AS (SELECT *, list_filter(l, lambda x: NOT {noisy('x')}) AS kept FROM d)
SELECT doc_id, (len(l) - len(kept))::BIGINT AS removed, md5(array_to_string(kept, {NL})) AS kept_md5 FROM k"""
SQL["nrm_tokens"] = f"""SELECT doc_id, ceil(w + (length(text) - w) / 3.5)::BIGINT AS tokens FROM (SELECT doc_id, text, length({rep('text', f'[^{CJK}]')}) AS w FROM ({agreements_sql()}))"""
SQL["nrm_clean"] = f"""SELECT doc_id, substr({trim(rep(rep("coalesce(text, '')", '[' + chr(92) + 'r' + chr(92) + 'n]+', "' '"), f'[{WS}]{{2,}}', "' '"))}, 1, 400) AS line FROM documents"""
SQL["redact_keys"] = """SELECT doc_id, md5(regexp_replace('key sk-' || md5(doc_id::VARCHAR) || ' and ' || coalesce(text, ''), '\\bsk-[A-Za-z0-9_-]{4,}', 'sk-***', 'g')) AS redacted_md5 FROM documents"""
SQL["tok_terms"] = f"""WITH a AS ({agreements_sql()}), t AS (
  SELECT unnest(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9''-]*|[0-9]+'), lambda x: lower(x))) AS term FROM a
  UNION ALL SELECT CASE WHEN length(r) = 1 THEN r ELSE substr(r, i, 2) END FROM (SELECT r, unnest(range(1, greatest(length(r), 2))) AS i FROM (SELECT unnest(regexp_extract_all(text, {rx(f'[{CJK}]+')})) AS r FROM a)))
SELECT term, count(*) AS n FROM t GROUP BY term"""
SQL["seg_lines"] = f"WITH a AS ({agreements_sql()}), {lines('a')} SELECT doc_id, pos, start, length(line)::BIGINT AS chars, rule FROM lines"
SQL["seg_clauses"] = f"{CLAUSES} SELECT doc_id, clause_id, heading, md5(text) AS text_md5, start, stop, rule AS heading_rule FROM clauses"
SQL["seg_stats"] = f"""WITH a AS ({agreements_sql()}), {lines('a')}, r AS (SELECT doc_id, rule, count(*) AS n FROM lines WHERE rule IS NOT NULL GROUP BY doc_id, rule)
SELECT doc_id, 'structure' AS strategy, length(text)::BIGINT AS total_chars, rule, n FROM a JOIN r USING (doc_id)"""
SQL["prescan_hits"] = f"""{CLAUSES}, {hit_ctes()} SELECT doc_id, clause_id, category, severity, array_to_string(list_transform(ms, lambda m: substr(m, 1, {K.MATCH_CHARS})), '|') AS matches,
  array_to_string(list_transform(ms, lambda m: instr(text, m) - 1), ',') AS match_indexes FROM hits"""
SQL["findings"] = f"{FOUND} SELECT doc_id, 'f' || rank AS finding_id, clause_id, category, severity, quote, title, advice, fs AS start, fe AS stop FROM found"
SQL["findings_filter"] = f"""{FOUND} SELECT doc_id, 'f' || rank AS finding_id, category FROM found WHERE severity = 'high' AND (contains(title, '第三方') OR contains(quote, '第三方') OR contains(explanation, '第三方'))"""
SQL["risk_scores"] = f"""{FOUND}, s AS (SELECT d.doc_id, round(100 * (1 - exp(-coalesce(sum({_WEIGHT}), 0) / {float(K.SCORE_SCALE)})))::BIGINT AS score FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, score, {verdict('score')} AS verdict FROM s"""
SQL["category_summary"] = f"""{FOUND}, g AS (SELECT doc_id, category, any_value(severity) AS severity, count(*) AS count, min(rank) AS first, any_value(note) AS note FROM found GROUP BY doc_id, category)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {_SEV}, first) AS pos, category, severity, count, note FROM g"""
SQL["severity_counts"] = f"{FOUND} SELECT doc_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in T.SEVERITIES) + " FROM found GROUP BY doc_id"
SQL["group_rollup"] = f"{FOUND} SELECT grp, category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY ROLLUP (grp, category)"
_TONES = f"""tones AS (SELECT c.doc_id, c.clause_id, c.idx, c.heading, c.text, CASE WHEN min({_SEV}) <= 1 THEN 'unfavorable' WHEN min({_SEV}) IS NOT NULL THEN 'mixed' ELSE 'neutral' END AS tone
FROM clauses c LEFT JOIN found f ON f.doc_id = c.doc_id AND f.clause_id = c.clause_id GROUP BY ALL)"""
SQL["clause_tones"] = f"{FOUND}, {_TONES} SELECT doc_id, clause_id, tone FROM tones"
SQL["clause_notes"] = f"""{FOUND}, {_TONES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS nth, {trim(rep('heading', f'[{WS}]+', "' '"))} AS h, {trim(rep('text', f'[{WS}]+', "' '"))} AS body FROM tones WHERE length({trim('text')}) >= {K.NOTE_FROM}),
p AS (SELECT *, CASE WHEN length(h) < 4 THEN regexp_extract(body, '^[^。！？；.!?;]*[。！？；.!?;]?') ELSE h END AS plain0 FROM n WHERE nth <= {K.MAX_NOTES})
SELECT doc_id, 'n' || nth AS note_id, clause_id, CASE WHEN length(plain0) > 40 THEN substr(plain0, 1, 40) || '…' ELSE plain0 END AS plain, tone FROM p"""
_RULES = ", ".join(f"({i}, '{a}', '{b}', '{sev}', {lit(title)})" for i, ((a, b), sev, title, _, _) in enumerate(T.INTERACTIONS))
SQL["interactions"] = f"""{FOUND}, first AS (SELECT doc_id, category, arg_min(clause_id, rank) AS c FROM found GROUP BY doc_id, category), rules(pos, a, b, severity, title) AS (VALUES {_RULES})
SELECT x.doc_id, 'x' || row_number() OVER (PARTITION BY x.doc_id ORDER BY pos) AS interaction_id, CASE WHEN x.c = y.c THEN x.c ELSE x.c || '+' || y.c END AS clause_ids, severity, title
FROM rules JOIN first x ON x.category = a JOIN first y ON y.category = b AND y.doc_id = x.doc_id"""
_POOL = ", ".join(f"({i}, '{c}', {lit(q)})" for i, (c, q) in enumerate(K.QUESTION_POOL))
SQL["suggested_questions"] = f"""{FOUND}, pool(pos, category, q) AS (VALUES {_POOL}), ranked AS (SELECT doc_id, pos, q, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT DISTINCT doc_id, category FROM found) JOIN pool USING (category)),
s AS (SELECT doc_id, string_agg(q, '|' ORDER BY pos) AS questions FROM ranked WHERE n <= 3 GROUP BY doc_id)
SELECT doc_id, coalesce(questions, '') AS questions FROM (SELECT DISTINCT doc_id FROM found) LEFT JOIN s USING (doc_id)"""
SQL["reports"] = f"""{FOUND}, cc AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY doc_id),
s AS (SELECT n.doc_id, length(n.text) AS chars, coalesce(cc.n, 0) AS clauses, count(f.doc_id) AS nf, count(*) FILTER (severity = 'critical') AS nc, count(*) FILTER (severity = 'high') AS nh, round(100 * (1 - exp(-coalesce(sum({_WEIGHT}), 0) / {float(K.SCORE_SCALE)})))::BIGINT AS score,
  string_agg(clause_id || ':' || f.title || ':' || severity, '|' ORDER BY rank) FILTER (rank <= 5) AS tops FROM norm n LEFT JOIN cc USING (doc_id) LEFT JOIN found f ON f.doc_id = n.doc_id GROUP BY n.doc_id, n.text, cc.n),
g AS (SELECT doc_id, title, any_value(severity) AS severity, min(rank) AS first FROM found GROUP BY doc_id, title), gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_SEV}, first) AS pos FROM g),
gl AS (SELECT doc_id, string_agg(title, '、' ORDER BY pos) FILTER (pos <= 3) AS tops3 FROM gr GROUP BY doc_id),
a0 AS (SELECT doc_id, advice, min(rank) AS first FROM found GROUP BY doc_id, advice), a1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS pos FROM a0),
al AS (SELECT doc_id, string_agg(advice, '|' ORDER BY pos) FILTER (pos <= 5) AS acts FROM a1 GROUP BY doc_id)
SELECT doc_id, score AS risk_score, {verdict('score')} AS verdict, CASE WHEN nf = 0 THEN '本地规则扫描未在约 ' || chars || ' 字的协议中发现明显的红旗措辞。这并不等于协议没有问题——规则只能识别固定措辞，建议同时用模型分析以获得更全面的判断。'
  ELSE '本地规则在 ' || clauses || ' 个条款中命中 ' || nf || ' 处可疑表述，其中严重 ' || nc || ' 条、高 ' || nh || ' 条，整体风险分 ' || score || '。问题主要集中在' || tops3 || '等方面。由于该结果由关键词规则生成，可能存在误报，请结合原文自行确认。' END AS summary,
  nf AS n_findings, tops AS top_concerns, acts AS actions FROM s LEFT JOIN gl USING (doc_id) LEFT JOIN al USING (doc_id)"""
SQL["highlight_spans"] = f"""{FOUND}, m0 AS (SELECT *, max(fe) OVER (PARTITION BY doc_id ORDER BY fs, fe, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found WHERE fe > fs),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR fs >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY fs, fe, rank) AS island FROM m0)
SELECT doc_id, min(fs) AS start, max(fe) AS stop, string_agg('f' || rank, ',' ORDER BY fs, fe, rank) AS ids, arg_min(severity, {_SEV}) AS severity FROM m1 GROUP BY doc_id, island"""


def tokens(c: str) -> str:
    words = f"list_transform(regexp_extract_all({c}, '[a-zA-Z][a-zA-Z0-9''-]*|[0-9]+'), lambda x: lower(x))"
    runs = f"regexp_extract_all({c}, {rx(f'[{CJK}]+')})"
    return f"list_concat({words}, flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"


_QUESTIONS = [(1, "付了钱能退吗？"), (2, "账号被封了会怎样？"), (3, "我的数据会被共享给谁？"), (4, "发生争议要去哪里解决？"), (5, "trial renewal non-refundable fees"), (6, "公司年会在哪办")]
_Q = "q(question_id, question) AS (VALUES " + ", ".join(f"({i}, {lit(t)})" for i, t in _QUESTIONS) + ")"
_SYN = " UNION ALL ".join(f"SELECT question_id, unnest(flatten([{', '.join(tokens(lit(w)) for w in add)}])) AS term FROM q WHERE regexp_matches(question, {rx(p)})" for p, add in T.SYNONYMS)
_TERMS = f"{_Q}, qt0 AS (SELECT question_id, unnest({tokens('question')}) AS term FROM q UNION ALL {_SYN}), qt AS (SELECT question_id, term, count(*) OVER (PARTITION BY question_id) AS n_terms FROM (SELECT DISTINCT question_id, term FROM qt0))"
_INDEX = f"""tok AS (SELECT doc_id, clause_id, idx, {tokens('text')} AS body, {tokens("coalesce(heading, '')")} AS head FROM clauses),
ent AS (SELECT doc_id, clause_id, idx, (len(body) + 3 * len(head))::DOUBLE AS len FROM tok WHERE len(body) + len(head) > 0),
post AS (SELECT doc_id, clause_id, term, sum(w) AS tf FROM (SELECT doc_id, clause_id, unnest(body) AS term, 1 AS w FROM tok UNION ALL SELECT doc_id, clause_id, unnest(head), 3 FROM tok) GROUP BY ALL),
tot AS (SELECT count(*) AS total, avg(len) AS avg_len FROM ent),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(total) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, tot GROUP BY term),
med AS (SELECT idf AS median_idf FROM (SELECT idf, row_number() OVER (ORDER BY idf) - 1 AS n, count(*) OVER () AS c FROM idf) WHERE n = c // 2)"""
_SCORED = f"""sc AS (SELECT question_id, doc_id, clause_id, idx, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) * (1 + count(*) / any_value(n_terms)) AS score, count(*) AS matched, max(idf) AS top
  FROM post JOIN qt USING (term) JOIN idf USING (term) JOIN ent USING (doc_id, clause_id), tot GROUP BY question_id, doc_id, clause_id, idx)"""
SQL["question_terms"] = f"WITH {_TERMS} SELECT question_id::BIGINT AS question_id, term, n_terms FROM qt"
SQL["idf"] = f"{CLAUSES}, {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["index_totals"] = f"{CLAUSES}, {_INDEX} SELECT total, round(avg_len, 6) AS avg_len, round(median_idf, 6) AS median_idf FROM tot, med"
SQL["bm25_topk"] = f"""{CLAUSES}, {_INDEX}, {_TERMS}, {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, idx) AS rank FROM sc)
SELECT question_id::BIGINT AS question_id, rank, round(score, 3) AS score, matched FROM r WHERE rank <= 20"""
SQL["bm25_loose"] = f"{CLAUSES}, {_INDEX}, {_TERMS}, {_SCORED} SELECT question_id::BIGINT AS question_id, count(*) AS n, round(max(score), 3) AS best, max(matched) AS most FROM sc GROUP BY question_id"
SQL["neighbors"] = f"{CLAUSES} SELECT b.doc_id, a.clause_id AS seed, b.clause_id FROM clauses a JOIN clauses b ON a.doc_id = b.doc_id AND b.idx BETWEEN 1 AND 2 WHERE a.idx = 0"
SQL["budget_prefix"] = f"""{CLAUSES}, t AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx) AS total FROM clauses)
SELECT doc_id, clause_id, least(length(text), 300)::BIGINT AS chars, idx = 0 AND total > 300 AS truncated FROM t WHERE total <= 300 OR idx = 0"""
SQL["rehydrate"] = f"""{CLAUSES}, h AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS half FROM norm), x AS (SELECT c.doc_id, substr(half, (c.start + 1)::BIGINT, (c.stop - c.start)::BIGINT) AS t, c.stop > length(half) AS lost FROM clauses c JOIN h USING (doc_id))
SELECT doc_id, count(*) AS n, count(*) FILTER (lost) AS lost, sum(length(t))::BIGINT AS chars FROM x WHERE NOT ({blank('t')}) GROUP BY doc_id"""
SQL["batch_pack"] = f"""WITH RECURSIVE {CLAUSES[5:]}, walk AS (
  SELECT doc_id, clause_id, idx, 0 AS batch, length(text) AS total FROM clauses WHERE idx = 0
  UNION ALL SELECT c.doc_id, c.clause_id, c.idx, CASE WHEN w.total + length(c.text) > 120 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.total + length(c.text) > 120 THEN length(c.text) ELSE w.total + length(c.text) END
  FROM walk w JOIN clauses c ON c.doc_id = w.doc_id AND c.idx = w.idx + 1)
SELECT doc_id, clause_id, batch::BIGINT AS batch FROM walk"""
SQL["kadane_run"] = """WITH v AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, l_quantity::DOUBLE - 25 AS x FROM lineitem),
runs AS (SELECT a.l_orderkey, a.i AS s, b.i + 1 AS e, sum(m.x) AS total FROM v a JOIN v b ON b.l_orderkey = a.l_orderkey AND b.i >= a.i JOIN v m ON m.l_orderkey = a.l_orderkey AND m.i BETWEEN a.i AND b.i GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY total DESC, e, s DESC) AS n FROM runs)
SELECT l_orderkey, s AS start, e AS stop, round(total, 6) AS total FROM best WHERE n = 1"""
SQL["quote_exact"] = "SELECT doc_id, item_id, instr(d.text, b.text) - 1 AS start FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)"
SQL["quote_owner_range"] = f"{FOUND} SELECT f.doc_id, 'f' || rank AS finding_id, c.clause_id FROM found f LEFT JOIN clauses c ON c.doc_id = f.doc_id AND f.fs >= c.start AND f.fs < c.stop"
_SEVS = ["high", "critical", "medium", "low", "critical", "info", "medium", "low"]
_CATS = ["arbitration", "data_sharing", "auto_renewal", "data_sharing", "other", "other", "refund", "refund"]
_TONE8 = ["favorable", "neutral", "unfavorable", "mixed", "neutral", "neutral", "unfavorable", "unfavorable"]
SQL["severity_alias"] = "SELECT doc_id, " + ", ".join(f"(list_value({', '.join(map(lit, v))}))[doc_id % 8 + 1] AS {n}" for n, v in (("severity", _SEVS), ("category", _CATS), ("tone", _TONE8))) + " FROM documents"


def _count_by(step: int, name: str) -> str:
    return f"{name} AS (WITH {normalized(agreements_sql(step))}, {clause_ctes()}, {hit_ctes()} SELECT doc_id, category, count(*) AS n FROM hits GROUP BY ALL)"


SQL["history_compare"] = f"""WITH {_count_by(5, 'a')}, {_count_by(7, 'b')}, x AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after
  FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.category = b.category)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(after - before) DESC, category) AS pos, category, before, after, after - before AS delta FROM x WHERE after <> before"""
SQL["history_retention"] = """SELECT id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at FROM (SELECT user_id::VARCHAR AS id, max(ts) AS saved_at FROM events GROUP BY user_id) ORDER BY saved_at DESC, id LIMIT 12"""
SQL["corpus_merge"] = """WITH c AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), m AS (SELECT doc_id, 'conversation' AS kind FROM c UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS ids FROM m GROUP BY kind"""


def stripped(c: str) -> str:
    out = c
    for tag in ("script", "style", "head", "nav", "footer"):
        out = rep(out, rf"(?is)<{tag}.*?</{tag}>", "' '")
    out = rep(rep(rep(out, r"(?i)<(br|hr)\s*/?>", NL), r"(?i)</(p|div|li|tr|h[1-6]|section|article)>", NL), "<[^>]+>", "' '")
    for name, raw in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;|&apos;", "''''"), ("&amp;", "'&'")):
        out = rep(out, f"(?i){name}", raw)
    line = trim(rep("l", "[ \\t]+", "' '"))
    return f"list_filter(list_transform(string_split({out}, {NL}), lambda l: {line}), lambda l: l <> '')"


def visible(c: str) -> str:
    for tag in ("script", "style", "noscript"):
        c = rep(c, rf"(?is)<{tag}.*?</{tag}>", "' '")
    return trim(rep(rep(c, "<[^>]+>", "' '"), f"[{WS}]+", "' '"))


SQL["html_strip"] = f"""SELECT page_id, md5(array_to_string({stripped("coalesce(html, '')")}, {NL})) AS text_md5 FROM pages"""
_SHELL = "'<html><body><div id=''app''></div><script>window.__NUXT__={}</script>' || repeat('<i></i>', 150) || '</body></html>'"
SQL["js_shell"] = f"""WITH h AS (SELECT page_id, unnest([coalesce(html, ''), {_SHELL}]) AS html FROM pages), v AS (SELECT *, length({visible('html')}) AS visible FROM h),
s AS (SELECT *, list_filter([CASE WHEN regexp_matches(html, '(?i)doesn''?t work properly without JavaScript|enable JavaScript|需要(启用|开启)\\s*JavaScript|请启用\\s*JavaScript') THEN 'no-js-hint' END,
  CASE WHEN regexp_matches(html, '(?i)<div[^>]+id=["''](app|root|__next|__nuxt)["''][^>]*>\\s*</div>') THEN 'empty-mount' END, CASE WHEN regexp_matches(html, '__NUXT__|__NEXT_DATA__|vue\\.config|createApp\\(|ReactDOM') THEN 'spa-framework' END,
  CASE WHEN length(html) > 800 AND visible < 400 THEN 'empty-visible-text' END], lambda x: x IS NOT NULL) AS sig FROM v)
SELECT page_id, array_to_string(sig, ',') AS signals, visible::BIGINT AS visible, visible < 400 AND len(sig) > 0 AS shell FROM s"""
SQL["html_tail_dedupe"] = f"""WITH p AS (SELECT page_id, {stripped("coalesce(html, '')")} AS ls FROM pages), l AS (SELECT page_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos, len(ls) AS n FROM p),
m AS (SELECT page_id, pos >= n - greatest(5, ceil(n * 0.25)) AND length(line) >= 6 AND row_number() OVER (PARTITION BY page_id, line ORDER BY pos) > 1 AS gone FROM l)
SELECT page_id, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS dropped FROM m GROUP BY page_id"""
SQL["url_normalize"] = f"""SELECT page_id, 'https://' || regexp_replace({rep("regexp_replace(coalesce(url, ''), '^https?://', '')", f'[{WS}]+')}, '^/+', '') AS url FROM pages"""
_HOSTS = ["127.0.0.1", "10.1.2.3", "172.20.0.9", "172.32.0.9", "localhost", "printer.local", "example.com", "192.168.1.1"]
SQL["url_private"] = f"""SELECT page_id, page_id % 8 IN (0, 1, 2, 4, 5, 7) AS private, page_id % 3 <> 0 AND page_id % 8 IN (3, 6) AS fetchable FROM pages"""
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_PARAMS = ", ".join(f"'{p}'" for p in K.TRACKING_PARAMS)
SQL["url_canonical_dedupe"] = f"""WITH u AS (SELECT page_id, """ + ", ".join(f"regexp_extract(url, {rx(_URL)}, {n}) AS u{n}" for n in range(1, 6)) + f""" FROM pages WHERE url IS NOT NULL),
k AS (SELECT page_id, lower(u1) || '://' || lower(u2) || CASE WHEN u3 = '' OR (lower(u1) = 'http' AND u3 = '80') OR (lower(u1) = 'https' AND u3 = '443') THEN '' ELSE ':' || u3 END || regexp_replace(u4, '/+$', '') AS base,
  array_to_string(list_filter(string_split(u5, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({_PARAMS})), '&') AS q FROM u)
SELECT base || CASE WHEN q = '' THEN '' ELSE '?' || q END AS key, min(page_id) AS page_id, count(*) AS n FROM k GROUP BY ALL"""
SQL["safe_filenames"] = f"""SELECT page_id, substr({trim(rep(rep("coalesce(url, '协议风险报告')", '[' + chr(92) * 2 + '/:*?"<>|' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't]', "'_'"), f'[{WS}]+', "' '"))}, 1, 60) AS name FROM pages"""
SQL["ingest_latest"] = "SELECT event_id, event_type, user_id FROM events WHERE event_id > 10 ORDER BY event_id DESC LIMIT 1"
SQL["daily_event_counts"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["json_text"] = f"""SELECT doc_id, md5(CASE WHEN length({trim('text')}) >= 40 AND regexp_matches({trim('text')}, {rx(f'[{WS}一-鿿]')}) THEN {trim('text')} ELSE '' END) AS text_md5 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""
SQL["file_formats"] = """SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 3 THEN 'json' ELSE 'html' END AS format FROM pages"""

_COLOUR = "CASE WHEN score <= 20 THEN '#16a34a' WHEN score <= 45 THEN '#0284c7' WHEN score <= 70 THEN '#d97706' ELSE '#dc2626' END"
SQL["display_formats"] = f"""WITH e AS (SELECT event_id, ts, event_id * 7919 AS n, event_id * 1373 % 200000 AS ms, event_id * 104729 % 5000000 AS b, event_id % 101 AS score, event_id % 7 AS st FROM events)
SELECT event_id, format('{{:,}}', n) AS number,
  CASE WHEN ms <= 0 THEN '—' WHEN ms < 1000 THEN ms || ' 毫秒' WHEN ms < 60000 THEN printf('%.1f', floor(ms / 100.0 + 0.5) / 10) || ' 秒' ELSE (ms // 60000) || ' 分 ' || floor((ms % 60000) / 1000.0 + 0.5)::BIGINT || ' 秒' END AS duration,
  CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b * 10 / 1024.0 + 0.5) / 10) || ' KB' ELSE printf('%.2f', floor(b * 100 / 1048576.0 + 0.5) / 100) || ' MB' END AS size,
  strftime(ts, '%Y/%m/%d %H:%M') AS moment, {_COLOUR} AS colour,
  CASE WHEN st < 6 THEN round(least(96, (st + CASE WHEN st = 3 THEN least(score / 100.0, 1) ELSE 0 END) / 6.0 * 80), 6) END AS progress FROM e"""
SQL["search_results"] = """WITH p AS (SELECT page_id, url, page_id % 2 = 1 AS odd FROM pages WHERE url IS NOT NULL)
SELECT page_id AS query_id, 1::BIGINT AS n, url, CASE WHEN odd THEN 0 ELSE 1 END::BIGINT AS repeated, 1::BIGINT AS invalid, CASE WHEN odd THEN 1 ELSE 0 END::BIGINT AS untitled,
  '[1] Page ' || page_id || chr(10) || '    ' || url || chr(10) || '    Terms & rules' AS block FROM p"""
SQL["clause_index"] = f"{CLAUSES} SELECT doc_id, clause_id, heading, start, stop, length(text)::BIGINT AS chars, rule AS heading_rule FROM clauses"
SQL["clause_hints"] = f"{CLAUSES}, {hit_ctes()} SELECT doc_id, clause_id, string_agg(category, '、' ORDER BY cat_pos) AS hints FROM hits GROUP BY doc_id, clause_id"
SQL["ingest_texts"] = """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, trim(coalesce(text, ''), ' ') AS p, trim(CASE WHEN doc_id % 2 = 0 THEN substr(coalesce(text, ''), 1, 400) ELSE '' END, ' ') AS s FROM documents),
x AS (SELECT *, CASE WHEN length(s) > 300 THEN s ELSE p END AS c, sha256(doc_id || chr(31) || coalesce(lang, '')) AS h FROM d)
SELECT doc_id, CASE WHEN length(c) >= 50 THEN md5(substr(c, 1, 300000)) END AS sent_md5, length(p) >= 80 AS analysable,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, least(length(t), 1000)::BIGINT AS slim_chars, length(t) > 1000 AS truncated FROM x"""
