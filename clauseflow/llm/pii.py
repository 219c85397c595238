"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

Everything is made of DataFrame functions. A pattern's matches come from regexp_extract_all and the text between them from
split; adding up both lengths gives positions (code points, ends exclusive). Patterns start with a guard,
`(?:\\G|(?<!x))`: a match starts where a run of its characters does or where the last match ended, so that long runs are
read once and not once for each start. Sums over a text's matches run in blocks, as an array that grows by one element is
copied each time: time is linear in the text, and in its matches up to BLOCK times their number. Groups that repeat without bound do so possessively, which Java's regular
expressions do in a loop; otherwise they recurse, and a text with very many repeats would overflow the stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_FROM = 0.5
CONTEXT_CHARS = 40
#: Elements that a running sum takes at a time.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: how it is proposed, confirmed and scored.

    score is what a match has before context, lift what context words within CONTEXT_CHARS in front of it add. needs: text
    without this string has no match. fixed kinds are kept whatever their score.
    """

    name: str
    pattern: str
    needs: str | None
    score: float
    lift: float
    words: str
    fixed: bool = True
    valid: Callable[[Column], Column] | None = None


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of figures passes the Luhn check."""
    n = F.length(number)

    def term(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and figures) has remainder 1: its first four characters go to the end, letters count as 10 to 35."""
    plain = F.upper(F.regexp_replace(code, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _octets(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def _card(m: Column) -> Column:
    d = digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))


# The four base forms, in their order, then what the method adds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", ".", 0.6, 0.3, "ip|address|host|server|adresse", valid=_octets),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+", None, 0.7, 0.3, "card|visa|credit|karte|carte|tarjeta", valid=_card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.3, "tel|phone|call|fax|mobil", valid=lambda m: F.length(digits(m)).between(10, 15)),
    Kind("iban", r"\b[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}\b", None, 0.8, 0.2, "iban|account|konto|compte|cuenta", False, mod97),
    Kind("ssn", r"\b[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]\b", "-", 0.3, 0.6, "ssn|social security", False),
    Kind("local_phone", r"\b[0-9][0-9][0-9][\x20.-][0-9][0-9][0-9][\x20.-][0-9][0-9][0-9][0-9]\b", None, 0.3, 0.5, "tel|phone|call|fax|mobil", False),
)
BASE = tuple(k.name for k in KINDS if k.fixed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """The array that step makes of items, one after the other: step(state, item) gives the next state and an element."""
    none, blocks = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")

    def one(a: Column, item: Column) -> Column:
        after, out = step(a["state"], item)
        return F.struct(after.alias("state"), F.concat(a["out"], F.array(out)).alias("out"))

    def block(a: Column, part: Column) -> Column:
        return _let(F.aggregate(part, F.struct(a["state"].alias("state"), none.alias("out")), one), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def all_of(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(parts, F.struct(state.alias("state"), blocks.alias("out")), block)["out"])).otherwise(none)

    return _let(items, all_of)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """The kind's confirmed spans: array of (start, rank, end, kind, score)."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = _let(found, lambda ms: F.zip_with(ms, F.slice(gaps, F.lit(1), F.size(ms)), lambda m, g: F.struct(m.alias("m"), g.alias("gap"))))
    last = lambda *parts: F.right(F.concat(*parts), F.lit(CONTEXT_CHARS))

    def place(state: Column, p: Column) -> tuple[Column, Column]:
        start, near = state["at"] + F.length(p["gap"]), last(state["near"], last(p["gap"]))
        end = start + F.length(p["m"])
        return F.struct(end.alias("at"), last(near, last(p["m"])).alias("near")), F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m"), near.alias("near"))

    placed = running(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("near")), place, "struct<start:int,end:int,m:string,near:string>")
    good = F.filter(placed, lambda s: kind.valid(s["m"])) if kind.valid else placed

    def scored(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(F.lower(s["near"]).rlike(rf"\b(?:{kind.words})"), F.lit(kind.lift)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    out = F.transform(good, scored)
    if not kind.fixed:
        out = F.filter(out, lambda s: s["score"] >= KEEP_FROM)
    may = (F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)) & text.rlike(kind.pattern)
    return F.when(may, out).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(spans: Column) -> Column:
    """Spans (sorted) without added ones that overlap a base one: a base one that begins no later and ends behind their start,
    seen on the way forth, or the next one to begin, seen on the way back."""
    flagged = f"struct<s:{_SPAN},over:boolean>"
    base = lambda s: s["rank"] < len(BASE)

    def forth(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(base(s), F.greatest(reach, s["end"])).otherwise(reach), F.struct(s.alias("s"), (~base(s) & (reach > s["start"])).alias("over"))

    def back(begins: Column, x: Column) -> tuple[Column, Column]:
        return F.when(base(x["s"]), x["s"]["start"]).otherwise(begins), F.struct(x["s"].alias("s"), (x["over"] | (~base(x["s"]) & (begins < x["s"]["end"]))).alias("over"))

    there = running(spans, F.lit(0), forth, flagged)
    again = running(F.reverse(there), F.lit(2**31 - 1), back, flagged)
    return F.transform(F.filter(F.reverse(again), lambda x: ~x["over"]), lambda x: x["s"])


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `pii` (replacing a column of that name): (start, rank, end, kind, score) by start, then kind.

    The fixed kinds may overlap each other; the others give way to them. Null and empty texts have none; repeated rows count
    each, an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.array_sort(F.concat(*(_spans(t, i, k) for i, k in enumerate(KINDS))))
    clean = lambda a: F.when(F.exists(a, lambda s: s["rank"] >= len(BASE)), _apart(a)).otherwise(a)
    return docs.withColumn("pii", _let(found, clean))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of their list, and the list of all spans, one row per row of docs.

    Null and empty texts have none, repeated rows count each; other columns of docs are left out.
    """
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    spans = F.col("pii")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
