"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op5_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), again AS (
  SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM win JOIN again USING (doc_id, k), (SELECT unnest(range(0, 5)) AS d) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), perdoc AS (
  SELECT doc_id, sum(n - 1) AS dup, sum(n) AS all_lines FROM lines GROUP BY doc_id
), base AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(all_lines, 0)::BIGINT AS n_lines,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN perdoc USING (doc_id)
), flagged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // greatest(n_words, 1) AS m1,
    1000 * n_dup_lines // greatest(n_lines, 1) AS m2, 100 * word_chars // greatest(n_words, 1) AS m3 FROM base
), long AS (
  SELECT lang, source, m, v - v % (1 << greatest(length(bin(v)) - 6, 0)) AS bin
  FROM (SELECT lang, source, unnest([1, 2, 3]) AS m, unnest([m1, m2, m3]) AS v FROM flagged WHERE NOT base_failed)
), bins AS (
  SELECT 2 AS level, lang, source, m, bin, count(*) AS n FROM long GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, m, bin, count(*) FROM long GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, m, bin, count(*) FROM long GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM bins
), quant AS (
  SELECT level, lang, source, m, any_value(total) AS total, min(bin) FILTER (seen >= (total + 1) // 2) AS mid,
    min(bin) FILTER (seen >= (CASE m WHEN 2 THEN 99 ELSE 90 END * total + 99) // 100) AS high FROM running GROUP BY ALL
), fence AS (
  SELECT level, lang AS l, source AS s, any_value(total) AS total, max(high + 2 * (high - mid)) FILTER (m = 1) AS f1, max(high + 2 * (high - mid)) FILTER (m = 2) AS f2, max(high + 2 * (high - mid)) FILTER (m = 3) AS f3
  FROM quant GROUP BY ALL
), fences AS (
  SELECT g.l, g.s, CASE WHEN g.total >= 50 THEN [g.f1, g.f2, g.f3] WHEN u.total >= 50 THEN [u.f1, u.f2, u.f3] ELSE [a.f1, a.f2, a.f3] END AS f
  FROM fence g JOIN fence u ON g.level = 2 AND u.level = 1 AND g.l IS NOT DISTINCT FROM u.l JOIN fence a ON a.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(m1 - m1 % (1 << greatest(length(bin(m1)) - 6, 0)) > f[1] OR m2 - m2 % (1 << greatest(length(bin(m2)) - 6, 0)) > f[2] OR m3 - m3 % (1 << greatest(length(bin(m3)) - 6, 0)) > f[3], FALSE) AS kept
FROM flagged LEFT JOIN fences ON lang IS NOT DISTINCT FROM l AND source IS NOT DISTINCT FROM s
"""



def _pii_sql() -> str:
    """Base and added kinds with their positions, without the guards that only save time."""
    # Fixed values, as in pii.py: kind, pattern, test of the match m, and for added kinds score, lift and context words.
    digits, plain = "regexp_replace(m, '[^0-9]', '', 'g')", "regexp_replace(m, '[^A-Z0-9]', '', 'g')"
    figure = f"substr({digits}, (length({digits}) - i)::BIGINT, 1)::INT"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN 2 * {figure} - CASE WHEN {figure} > 4 THEN 9 ELSE 0 END ELSE {figure} END)) % 10 = 0"
    turned = f"substr({plain}, 5) || substr({plain}, 1, 4)"
    mod97 = f"list_reduce(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, x: CASE WHEN x >= 10 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) % 97 = 1"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE", None),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255", None),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", None),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15", None),
        ("iban", r"\b[A-Z][A-Z][0-9][0-9](\x20?[A-Z0-9]){11,30}\b", mod97, (0.8, 0.2, "iban|account|konto|compte|cuenta")),
        ("ssn", r"\b[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]\b", "TRUE", (0.3, 0.6, "ssn|social security")),
        ("local_phone", r"\b[0-9][0-9][0-9][\x20.-][0-9][0-9][0-9][\x20.-][0-9][0-9][0-9][0-9]\b", "TRUE", (0.3, 0.5, "tel|phone|call|fax|mobil")),
    ]
    parts = []
    for rank, (kind, pattern, valid, added) in enumerate(kinds):
        keep = f"CASE WHEN regexp_matches(lower(substr(t, greatest(e - length(m) - 39, 1), least(e - length(m), 40))), '\\b(?:{added[2]})') THEN {added[0] + added[1]} ELSE {added[0]} END >= 0.5" if added else "TRUE"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM (
    SELECT doc_id, t, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM (
      SELECT doc_id, t, i, ms[i] AS m, gs[i] AS g FROM (
        SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM docs)))
  ) WHERE ({valid}) AND {keep}""")
    return (
        "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + "\n  UNION ALL".join(parts) + r"""
), kept AS (
  SELECT * FROM found f WHERE rank < 4 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.rank < 4 AND b.doc_id = f.doc_id AND f.s < b.e AND b.s < f.e)
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (doc_id)
"""
    )


SQL["op6_personal_data"] = _pii_sql()

SQL["op1_warc_captures"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

SQL["op4_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, ws, least(10, len(ws)) AS w
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item, w, array_to_string(ws[j:j+w-1], ' ') AS k FROM (SELECT item, w, ws, unnest(range(1, len(ws) - w + 2)) AS j FROM b)
), dw AS (
  SELECT doc_id, w, i, array_to_string(ws[i:i+w-1], ' ') AS k FROM (SELECT doc_id, w, ws, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM b))
), m AS (
  SELECT doc_id, i, w, item FROM dw JOIN bw USING (w, k)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SQL["op9_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op3_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM d)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b
), comp AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN size USING (doc_id) JOIN comp ON a = doc_id
"""
