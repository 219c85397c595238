"""A linear-chain conditional random field over whitespace tokens: O outside, B first token of a secret, I further tokens.

Features are the token's shape, its neighbours' shapes and words, and what the whole text looks like. The weights are
learned here, by gradient ascent on the exact log-likelihood, from sentences that `examples` makes from a fixed seed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np

O, B, I = 0, 1, 2  # noqa: E741
SEED, SENTENCES, EPOCHS, RATE, DECAY = 3, 900, 6, 0.15, 1e-4
# Words that announce a secret, and the public prefixes of common credentials.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private_key", "access_key", "auth", "bearer")
PREFIXES = ("ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "npm_", "hf_")
SIZES = (0, 3, 7, 11, 15, 19, 23, 31, 39, 63, 1 << 60)
PEM_WORDS = ("private", "rsa", "openssh", "ec")
_WRAP = "\"'`,.;:()[]{}<>!*#$%&|"
_HEX, _B64, _ALNUM = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[A-Za-z0-9+/_=-]+"), re.compile(r"[A-Za-z0-9]+")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


@lru_cache(20_000)
def shape(token: str) -> tuple[str, ...]:
    """What the token alone shows."""
    core = token.strip(_WRAP)
    if "=" in core and not core.endswith("="):
        core = core.rpartition("=")[2].strip(_WRAP)
    low, n = token.lower(), len(core)
    digits = sum(c in "0123456789" for c in core)
    upper = sum(c.isupper() for c in core)
    letters = sum(c.isalpha() for c in core)
    if n and digits == n:
        kind = "digits"
    elif not digits and letters == n:
        kind = "word" if upper in (0, 1) or upper == n else "camel"
    elif _HEX.fullmatch(core):
        kind = "hex"
    elif _ALNUM.fullmatch(core):
        kind = "alnum3" if upper and digits and letters > upper else "alnum2"
    elif _B64.fullmatch(core):
        kind = "b64" if digits and letters else "dashed"
    else:
        kind = "other"
    size = next(str(k) for k in SIZES if n <= k)
    out = [f"kind={kind}", f"size={size}", f"kind,size={kind},{size}", f"entropy={min(int(entropy(core) * 2), 9)}", f"mix={digits > 2 and letters > 2 and n >= 16}"]
    out += [f"prefix={any(core.startswith(p) and n > len(p) + 11 for p in PREFIXES)}"]
    if any(k in low for k in KEYWORDS):
        out.append("keyword")
    out += [name for name, yes in (("at", "@" in core), ("dot", "." in core), ("url", "://" in core), ("quoted", token[:1] in "\"'`"), ("assigned", "=" in token.rstrip("=") or ":" in token[:-1]), ("opens", token[-1:] in "=:"), ("pem", "-----" in token)) if yes]
    return tuple(out)


@lru_cache(20_000)
def role(token: str) -> str:
    """What the token tells about its neighbours."""
    low = token.lower()
    if token in ("=", ":", ":=", "=>", "->"):
        return "op"
    if "-----begin" in low:
        return "begin"
    if "-----" in low:
        return "end"
    if any(k in low for k in KEYWORDS):
        return "keyword"
    if "key-----" in low or low in PEM_WORDS:
        return "pemword"
    if any(c in "0123456789" for c in token):
        return "figures"
    return "plain"


ROLES = ("op", "begin", "end", "keyword", "pemword", "figures", "plain", "edge")
KINDS = ("digits", "word", "camel", "hex", "alnum3", "alnum2", "b64", "dashed", "other")


def token_features(tokens: list[str], i: int, about: str) -> list[str]:
    at = lambda k: role(tokens[k]) if 0 <= k < len(tokens) else "edge"
    own = shape(tokens[i])
    out = ["bias", *own, f"-1={at(i - 1)}", f"-2={at(i - 2)}", f"+1={at(i + 1)}", f"-2-1={at(i - 2)},{at(i - 1)}", f"-1,{own[0]}={at(i - 1)}", about]
    if at(i - 1) == "op" or at(i - 1) == "keyword":
        out.append(f"after,{own[2]}")
    return out


def about_text(n_tokens: int, n_figures: int) -> str:
    """The text as a whole: how many of its tokens have figures in them."""
    share = n_figures / max(1, n_tokens)
    return f"text={'none' if not n_figures else 'few' if share < 0.02 else 'some' if share < 0.2 else 'many'}"


def examples(n: int = SENTENCES, seed: int = SEED) -> list[tuple[list[str], list[int]]]:
    """Made-up sentences with credentials of many forms, and with figures that are none."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    draw = lambda chars, lo, hi: "".join(pick(chars) for _ in range(int(r.integers(lo, hi + 1))))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    tail = ["", "", "", ".", ",", "!!", "***", "###", "$$$"]

    def word() -> str:
        w = draw(low, 1, 12)
        return pick([w, w, w, w, w.capitalize(), w.upper()]) + pick(tail)

    def secret() -> list[str]:
        return pick([
            lambda: [draw(dig + "abcdef", 32, 64)], lambda: [pick(PREFIXES) + draw(low + up + dig, 20, 40)], lambda: ["AKIA" + draw(up + dig, 16, 16)],
            lambda: [draw(low + up + dig + "+/", 30, 60) + pick(["", "=", "=="])], lambda: ["eyJ" + draw(low + up + dig, 18, 30) + "." + draw(low + up + dig, 20, 40)],
            lambda: ["-----BEGIN", pick(["RSA", "EC", "OPENSSH"]), "PRIVATE", "KEY-----", *(draw(low + up + dig + "+/", 40, 64) for _ in range(int(r.integers(1, 4)))), "-----END", "RSA", "PRIVATE", "KEY-----"],
        ])()

    def figures() -> list[str]:
        return pick([
            lambda: [draw(dig, 1, 6)], lambda: [draw(dig, 14, 19)], lambda: ["+1", f"({draw(dig, 3, 3)})", f"{draw(dig, 3, 3)}-{draw(dig, 4, 4)}"],
            lambda: [f"{draw(low, 2, 9)}.{draw(dig, 2, 2)}@mail{draw(dig, 1, 1)}.example.com"], lambda: [".".join(draw(dig, 1, 3) for _ in range(4))],
            lambda: [f"https://{draw(low, 4, 9)}.com/{draw(low, 3, 12)}/{draw(dig, 1, 5)}?id={draw(dig, 1, 5)}"], lambda: ["v" + draw(dig, 1, 1) + "." + draw(dig, 1, 2)],
            lambda: [f"20{draw(dig, 2, 2)}-{draw(dig, 2, 2)}-{draw(dig, 2, 2)}T{draw(dig, 2, 2)}:{draw(dig, 2, 2)}Z"], lambda: [draw(low, 20, 45)], lambda: [draw(low, 3, 8) + "-" + draw(low, 3, 8) + "_" + draw(dig, 1, 3)],
            lambda: [pick(["x", "total", "page", "size"]), "=", draw(dig, 1, 5)], lambda: [pick(KEYWORDS), *(draw(low, 2, 8) for _ in range(2))], lambda: [draw(up, 20, 40) + "!!"],
        ])()

    out = []
    for _ in range(n):
        tokens: list[str] = []
        tags: list[int] = []
        for _ in range(int(r.integers(1, 4))):
            plain = [word() for _ in range(int(r.integers(1, 7)))]
            tokens += plain
            tags += [O] * len(plain)
            if r.random() < 0.5:
                value = secret()
                if len(value) == 1:
                    lead, form = pick(KEYWORDS), int(r.integers(7))
                    lead = pick([lead, lead.upper(), "my_" + lead])
                    quote = pick(['"', "'", ""])
                    v = quote + value[0] + quote + pick(tail)
                    front, value = [([], [v]), ([lead, pick("=:")], [v]), ([lead + pick("=:")], [v]), ([], [f"{lead}={v}"]), ([], [v]), ([lead, "is"], [v]), ([lead], [v])][form]
                    tokens += front
                    tags += [O] * len(front)
                tokens += value
                tags += [B] + [I] * (len(value) - 1)
            else:
                f = figures()
                tokens += f
                tags += [O] * len(f)
        out.append((tokens, tags))
    return out


class Field:
    """Weights: feature x tag, and tag x tag; the tag before the first token is O."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, tokens: list[str], about: str, span: range | None = None) -> np.ndarray:
        get = self.index.get
        return np.array([sum((self.emit[k] for f in token_features(tokens, i, about) if (k := get(f)) is not None), np.zeros(3)) for i in span or range(len(tokens))])

    def decode(self, scores: np.ndarray, more: bool = False) -> list[int]:
        """Viterbi; ties go to the lower tag. With more, a token tagged O follows."""
        best, back = scores[0] + self.move[O], []
        for s in scores[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + s
        tag = int((best + self.move[:, O] if more else best).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]

    def weight(self, feature: str) -> np.ndarray:
        k = self.index.get(feature)
        return np.zeros(3) if k is None else self.emit[k]

    def tables(self) -> Tables:
        return Tables(self)

    def reach(self) -> tuple[float, int]:
        """(m, r): every secret of the best tagging lies within r tokens of tokens that are not dull, and a token is dull if B
        and I score less than O there by more than m, a step inside a secret included.

        All against tagging O throughout, let e be the most that entering a secret can gain, c a step inside it, x leaving it.
        A secret of dull tokens alone scores at most e + x - c - m, so m makes that negative. Where a secret ends in dull
        tokens, leaving out n of them gains over n * m, and costs at most another way out; where it begins with some, another
        way in; where it has some in the middle, one way out, one way in and a step. r bounds n in all three cases.
        """
        t = self.move - self.move[O, O]
        into, out, inside = t[O, 1:], t[1:, O], t[1:, 1:]
        e, x, c = into.max(), max(out.max(), 0.0), inside.max()
        m = max(e + x - c, 0.0) + 1.0
        ends, begins, middle = x - out.min(), e - into.min(), c - out.min() - into.min()
        return float(m), int(max(ends, begins, middle) / m) + 1


class Tables:
    """A field's weights by what a token is and what stands beside it, so that whole arrays of tokens are scored by lookup.

    Plain words needn't be looked at one by one: `plain` has, for each size, scores against O that no word can exceed.
    """

    def __init__(self, field: Field):
        w, self.field = field.weight, field
        self.before, self.before2, self.after = (np.array([w(f"{k}={r}") for r in ROLES]) for k in ("-1", "-2", "+1"))
        self.two = np.array([[w(f"-2-1={a},{b}") for b in ROLES] for a in ROLES])
        self.kind = np.array([[w(f"-1,kind={k}={r}") for r in ROLES] for k in KINDS])
        self.about = {x: w(x) for x in ("text=none", "text=few", "text=some", "text=many")}
        self.known: dict[str, tuple] = {}
        self.plain = np.array([[self._most(kinds, size) for size in SIZES] for kinds in (("word",), ("word", "camel", "other"))])

    def _most(self, kinds: tuple[str, ...], size: int) -> list[float]:
        """A row as from `token`, for a word of one of these kinds: the most that B and I can score above O, whatever its entropy."""
        w = self.field.weight
        rise = lambda v: v - v[O]
        own = [rise(w("bias") + w(f"kind={k}") + w(f"size={size}") + w(f"kind,size={k},{size}") + w("mix=False") + w("prefix=False") + w(f"entropy={e}")) for k in kinds for e in range(10)]
        behind = [rise(w(f"after,kind,size={k},{size}")) for k in kinds]
        near = [rise(w(f"-1,kind={k}={r}")) for k in kinds for r in ROLES] if len(kinds) > 1 else [np.zeros(3)]
        # What the kind makes of its neighbours is looked up for words; of other kinds, the most that it can be is added here.
        return [*(np.max(own, 0) + np.max(near, 0)), *np.max(behind, 0), KINDS.index("word") if len(kinds) == 1 else -1, ROLES.index("plain")]

    def token(self, token: str) -> tuple:
        """(own scores x 3, scores behind an operator or keyword x 3, kind, role) of a token."""
        got = self.known.get(token)
        if got is None:
            own = shape(token)
            total = sum((self.field.weight(f) for f in own), self.field.weight("bias"))
            got = (*total, *self.field.weight(f"after,{own[2]}"), KINDS.index(own[0][5:]), ROLES.index(role(token)))
            if len(token) <= 200:
                if len(self.known) >= 1 << 17:
                    self.known.clear()
                self.known[token] = got
        return got

    def scores(self, info: np.ndarray, row: np.ndarray, about: np.ndarray) -> np.ndarray:
        """Scores of all tokens of some texts: info has a row of `token` for each, row its text, about its text's scores."""
        kind, own = info[:, 6].astype(int), info[:, 7].astype(int)
        edge = ROLES.index("edge")

        def beside(k: int) -> np.ndarray:
            out = np.full(len(own), edge)
            if k < 0:
                out[-k:] = np.where(row[-k:] == row[:k], own[:k], edge)
            else:
                out[:-k] = np.where(row[:-k] == row[k:], own[k:], edge)
            return out

        r1, r2, f1 = beside(-1), beside(-2), beside(1)
        told = np.isin(r1, (ROLES.index("op"), ROLES.index("keyword")))
        beside_kind = np.where(kind[:, None] >= 0, self.kind[kind, r1], 0.0)
        return info[:, :3] + self.before[r1] + self.before2[r2] + self.after[f1] + self.two[r2, r1] + beside_kind + about + np.where(told[:, None], info[:, 3:6], 0.0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


def fit(data: list[tuple[list[str], list[int]]]) -> Field:
    index: dict[str, int] = {}
    rows = []
    for tokens, tags in data:
        about = about_text(len(tokens) + int(30 * (len(rows) % 3)), sum(any(c in "0123456789" for c in t) for t in tokens))
        rows.append(([[index.setdefault(f, len(index)) for f in token_features(tokens, i, about)] for i in range(len(tokens))], tags))
    emit, move = np.zeros((len(index), 3)), np.zeros((3, 3))
    move[O, I] = -20.0  # a secret begins with B
    r = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for k in r.permutation(len(rows)):
            features, tags = rows[k]
            s = np.array([emit[f].sum(0) for f in features])
            n = len(s)
            a, z = np.zeros((n, 3)), np.zeros((n, 3))
            a[0] = s[0] + move[O]
            for i in range(1, n):
                a[i] = s[i] + _logsum(a[i - 1][:, None] + move, 0)
            for i in range(n - 2, -1, -1):
                z[i] = _logsum(move + s[i + 1] + z[i + 1], 1)
            total = _logsum(a[-1], 0)
            p = np.exp(a + z - total)
            for i, f in enumerate(features):
                step = -p[i]
                step[tags[i]] += 1
                emit[f] += rate * (step - DECAY * emit[f])
            grad = np.zeros((3, 3))
            for i in range(1, n):
                grad -= np.exp(a[i - 1][:, None] + move + s[i] + z[i] - total)
                grad[tags[i - 1], tags[i]] += 1
            grad[O, I] = 0
            move += rate * (grad - DECAY * move)
    return Field(index, emit, move)


@lru_cache(1)
def trained() -> Field:
    return fit(examples())
