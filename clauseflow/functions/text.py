"""Text functions from Column to Column, all inside Spark's own expressions.

Positions and lengths are code points. Blank space means what browsers trim: ASCII blanks, the Unicode spaces and U+FEFF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseflow import constants as K
from clauseflow import taxonomy as T

# Character classes, as text for a bracket expression.
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
WS = "\\t-\\r " + SPACES + "\u2028\u2029\ufeff"
ZERO_WIDTH = "\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff"
CJK = "\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff"
FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Lines that are page numbers or rows of figures.
NOISE = (
    rf"^[{WS}]*[-—–]?[{WS}]*[0-9]{{1,4}}[{WS}]*[-—–]?[{WS}]*$",
    rf"(?i)^[{WS}]*(第[{WS}]*[0-9]+[{WS}]*页|共[{WS}]*[0-9]+[{WS}]*页|Page[{WS}]+[0-9]+([{WS}]+of[{WS}]+[0-9]+)?)[{WS}]*$",
    rf"^[{WS}]*[0-9./-][0-9{WS}./-]{{0,9}}[{WS}]*$",
)


@lru_cache(1)
def composable() -> str:
    """Pattern of all characters that Unicode's composed form may change or merge with what stands before.

    Ranges less than 128 apart are one, as each range costs time for each character; a few more texts are composed for it.
    """
    second = {d[-1] for i in range(0x80, 0x10000) if len(d := unicodedata.normalize("NFD", chr(i))) > 1}
    odd = [i for i in range(0x80, 0x10000) if chr(i) in second or unicodedata.combining(chr(i)) or not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFC", chr(i)) != chr(i)]
    parts, start, gaps = [], None, [f"\\x00-\\u{odd[0] - 1:04x}"]
    for i, n in zip(odd, [*odd[1:], 0x10000], strict=True):
        start = i if start is None else start
        if n > i + 128:
            parts.append(f"\\u{start:04x}-\\u{i:04x}")
            gaps += [f"\\u{i + 1:04x}-\\u{n - 1:04x}"] if n > i + 4096 else []
            start = None
    return f"(?![{''.join(gaps)}])[{''.join(parts)}\\x{{10000}}-\\x{{10ffff}}]"  # most characters fail at the few wide gaps


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def trim_held(c: Column) -> Column:
    """trim of a column at hand, not of an expression: it is named several times, so that only blank ends cost a pattern."""
    return F.when(F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(f"[{WS}\\x85]"), trim(c)).otherwise(c)  # $ looks over a last U+0085


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def clean(c: Column, most: int) -> Column:
    """One line: line breaks and runs of blanks become one space, ends are trimmed, the rest is cut."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), rf"[{WS}]{{2,}}", " ")
    return F.substring(trim(one), 1, most)


def drop_invisible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{ZERO_WIDTH}\u00ad]", "")


def fold_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACES}]", " ")


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def unify_lines(c: Column) -> Column:
    """Everything of normalisation up to hyphens: line ends, invisible characters, spaces, widths, tabs, trailing blanks.

    A text without any of these stays as it is; one pattern and two plain searches tell.
    """
    t = half_width(fold_spaces(drop_invisible(F.regexp_replace(c, "\r\n?", "\n"))))
    done = F.regexp_replace(F.regexp_replace(t, "\t", " "), r"[ ]+(?=\n|\z)", "")
    odd = c.rlike(f"(?![\\x0a\\x20-\\x9f\\u00ae-\\u167f\\u3001-\\ufefe])[\r\t\u00ad{ZERO_WIDTH}{SPACES}{FULL}]")
    return F.when(odd | c.contains(" \n") | c.endswith(" "), done).otherwise(c)


def dehyphenate(c: Column) -> Column:
    return F.when(c.contains("-\n"), F.regexp_replace(c, r"([A-Za-z])-\n(?=[a-z])", "$1")).otherwise(c)


def break_long_lines(c: Column) -> Column:
    """Lines over LONG_LINE characters are cut behind sentence marks, once a piece has LEAST_PIECE characters.

    The shortest run of at least that many characters that ends in a mark is what a character-by-character walk cuts off.
    """
    cut = rf"\G([^\n]{{{K.LEAST_PIECE - 1},}}?[。！？；!?;])(?=[^\n])"  # \G: a piece starts where the last one ended, so a line is read once
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(F.length(x) > K.LONG_LINE, F.regexp_replace(x, cut, "$1\n")).otherwise(x))
    return F.array_join(lines, "\n")


def is_noise(line: Column) -> Column:
    return line.rlike(rf"^[{WS}]*[-—–0-9./第共Pp]") & (line.rlike(NOISE[0]) | line.rlike(NOISE[1]) | line.rlike(NOISE[2]))


def drop_noise(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_noise(x)), "\n")


def collapse(c: Column) -> Column:
    """Runs of spaces and of line breaks, and blank ends; c is named several times (see trim_held)."""
    runs = F.when(c.contains("  ") | c.contains("\n\n\n"), trim(F.regexp_replace(F.regexp_replace(c, "[ ]{2,}", " "), "\n{3,}", "\n\n")))
    return F.coalesce(runs, trim_held(c))


def normalize(c: Column) -> Column:
    """Normalised text of composed (NFC) text; null becomes empty."""
    return collapse(drop_noise(break_long_lines(dehyphenate(unify_lines(F.coalesce(c, F.lit("")))))))


def estimate_tokens(c: Column) -> Column:
    wide = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return F.ceil(wide + (F.length(c) - wide) / F.lit(3.5)).cast("int")


def redact_keys(c: Column) -> Column:
    return F.regexp_replace(c, r"\bsk-[A-Za-z0-9_-]{4,}", "sk-***")


def escape_html(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def tokenize(c: Column) -> Column:
    """Words and numbers in lower case, then pairs of neighbouring CJK characters (single ones as they are); repeats stay."""
    words = F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z][a-zA-Z0-9'-]*|[0-9]+"), F.lit(0)), F.lower)

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))

    return F.concat(words, F.flatten(F.transform(F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0)), pairs)))


def html_strip(c: Column) -> Column:
    """Text of HTML without parsing it: drops scripts, styles, head, navigation and footer, ends blocks with line breaks."""
    out = c
    for tag in ("script", "style", "head", "nav", "footer"):
        out = F.regexp_replace(out, rf"(?i)<{tag}[\s\S]*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?i)<(br|hr)\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|tr|h[1-6]|section|article)>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    # Entities that are read here, in this order.
    for name, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, f"(?i){name}", raw)
    lines = F.transform(F.split(out, "\n"), lambda x: trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def visible_text(c: Column) -> Column:
    out = c
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?i)<{tag}[\s\S]*?</{tag}>", " ")
    return trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), rf"[{WS}]+", " "))


def shell_signals(html: Column) -> Column:
    """What speaks for a page that scripts still have to fill."""
    # Patterns of the four signs.
    hint = r"(?i)doesn'?t work properly without JavaScript|enable JavaScript|需要(启用|开启)\s*JavaScript|请启用\s*JavaScript"
    mount = r"""(?i)<div[^>]+id=["'](app|root|__next|__nuxt)["'][^>]*>\s*</div>"""
    spa = r"__NUXT__|__NEXT_DATA__|vue\.config|createApp\(|ReactDOM"
    empty = (F.length(html) > 800) & (F.length(visible_text(html)) < 400)
    return F.array_compact(
        F.array(
            F.when(html.rlike(hint), F.lit("no-js-hint")), F.when(html.rlike(mount), F.lit("empty-mount")),
            F.when(html.rlike(spa), F.lit("spa-framework")), F.when(empty, F.lit("empty-visible-text")),
        )
    )


def is_js_shell(html: Column, extracted: Column) -> Column:
    return (F.length(visible_text(html)) < 400) & (F.length(trim(F.coalesce(extracted, F.lit("")))) < 400) & (F.size(shell_signals(html)) > 0)


def severity_rank(c: Column) -> Column:
    """0 for the worst severity; unknown ones rank below all."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(T.SEVERITIES) for x in (s, i))), c), F.lit(-1))


def normalize_severity(c: Column) -> Column:
    raw = trim(F.coalesce(c, F.lit("")))
    low = F.lower(raw)
    alias = F.element_at(F.create_map(*(F.lit(x) for kv in K.SEVERITY_ALIASES.items() for x in kv)), raw)
    starts = F.coalesce(
        F.when(low.startswith("crit"), "critical"), F.when(low.startswith("high") | low.startswith("sev"), "high"), F.when(low.startswith("med") | low.startswith("mod"), "medium"),
        F.when(low.startswith("low") | low.startswith("min"), "low"), F.when(low.startswith("info"), "info"), F.lit("medium"),
    )
    return F.coalesce(F.when(low.isin(*T.SEVERITIES), low), alias, starts)


def normalize_category(c: Column) -> Column:
    ids = [x[0] for x in T.CATEGORIES]
    raw = trim(F.coalesce(c, F.lit("")))
    snake = F.regexp_replace(F.regexp_replace(F.lower(raw), rf"[{WS}-]+", "_"), "[^A-Za-z0-9_]", "")
    label = F.element_at(F.create_map(*(F.lit(v) for x in T.CATEGORIES for v in (x[1], x[0]))), raw)
    return F.coalesce(F.when(raw.isin(*ids), raw), F.when(snake.isin(*ids), snake), label, F.lit("other"))


def normalize_tone(c: Column) -> Column:
    raw = trim(F.coalesce(c, F.lit("")))
    alias = F.element_at(F.create_map(*(F.lit(x) for kv in K.TONE_ALIASES.items() for x in kv)), raw)
    return F.coalesce(F.when(F.lower(raw).isin(*K.TONES), F.lower(raw)), alias, F.lit("neutral"))


def risk_score(weight: Column) -> Column:
    """0 to 100, saturating with the sum of severity weights."""
    return F.round(F.lit(100) * (F.lit(1) - F.exp(-weight / F.lit(float(K.SCORE_SCALE))))).cast("int")


def verdict(score: Column) -> Column:
    out = F.lit(K.VERDICTS[-1][1])
    for top, text in reversed(K.VERDICTS[:-1]):
        out = F.when(score <= top, F.lit(text)).otherwise(out)
    return out


def repair_url(c: Column) -> Column:
    s = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[\u200b-\u200f\ufeff]", ""), "：／", ":/")
    s = F.regexp_replace(s, rf"[{WS}]+", "")
    return F.when(s == "", F.lit(None)).when(s.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))


def url_part(url: Column, n: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query of an absolute URL, '' where there is none."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?", n)


def is_private_url(c: Column) -> Column:
    return F.lower(url_part(c, 2)).rlike(K.PRIVATE_HOST)


def is_fetchable(c: Column) -> Column:
    return F.lower(url_part(c, 1)).isin("http", "https") & (url_part(c, 2) != "") & ~is_private_url(c)


def url_key(c: Column) -> Column:
    """What makes two URLs the same page: no fragment, trailing slashes or tracking parameters, host in lower case."""
    query = url_part(c, 5)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).isin(*K.TRACKING_PARAMS))
    port, scheme = url_part(c, 3), F.lower(url_part(c, 1))
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    kept = F.array_join(params, "&")
    return F.concat(
        scheme, F.lit("://"), F.lower(url_part(c, 2)), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.regexp_replace(url_part(c, 4), "/+$", ""), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)),
    )


def safe_filename(title: Column) -> Column:
    base = F.regexp_replace(F.coalesce(title, F.lit("协议风险报告")), r'[\\/:*?"<>|\n\r\t]', "_")
    return F.substring(trim(F.regexp_replace(base, rf"[{WS}]+", " ")), 1, 60)
