"""Main text of HTML pages: a forgiving tree, boilerplate removal, scored candidates, and plain-text rendering."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Elements without content or whose content is raw, and what closes an open element by itself.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template"}
BLOCKS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}} | {f"h{i}": BLOCKS for i in range(1, 7)}
# What is dropped with everything in it.
DROP_TAGS = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "nav", "header", "footer", "aside", "form", "button", "select", "input", "label", "head", "textarea", "option", "optgroup", "map", "audio", "video", "source", "track", "picture", "dialog", "link", "meta", "base", "title"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "toolbar", "tablist"}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:nav|navigation|navbar|menu|sidebar|side-bar|footer|header|masthead|cookies?|consent|banner|gdpr|advert|ads?|sponsor(?:ed)?|promo|social|share|breadcrumbs?|pagination|pager|comments?|disqus|related|recommend(?:ed)?|popup|modal|overlay|subscribe|newsletter|skip-link|toolbar|site-header|site-footer|topbar|legal-nav|lang|language|language-switch)(?:$|[\s_-])",
    re.I,
)
HINT = re.compile("terms|tos|agreement|privacy|policy|legal|contract|eula|用户协议|服务协议|隐私政策|条款|协议", re.I)
PUNCTUATION = re.compile("[,.;:!?，。；：！？、·]")
#: Elements nest this deep, as in browsers.
MAX_DEPTH = 256
MIN_TEXT, KEEP_CHARS, MAX_CANDIDATES, LEAST_DENSITY = 400, 8000, 10, 0.3
# Named entities that are read; others stay as they are.
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½",
    "frac14": "¼", "frac34": "¾", "sup2": "²", "sup3": "³", "micro": "µ", "para": "¶", "sect": "§", "middot": "·", "bull": "•", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "sbquo": "‚", "bdquo": "„", "laquo": "«", "raquo": "»", "lsaquo": "‹", "rsaquo": "›", "dagger": "†", "permil": "‰", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "curren": "¤", "ensp": " ", "emsp": " ", "thinsp": " ", "zwnj": "", "zwj": "", "shy": "", "lrm": "", "rlm": "", "szlig": "ß", "auml": "ä", "ouml": "ö", "uuml": "ü", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "ntilde": "ñ", "larr": "←", "rarr": "→", "uarr": "↑", "darr": "↓", "infin": "∞", "ne": "≠", "le": "≤", "ge": "≥",
}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None


def decode_entities(s: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#":
            try:
                code = int(name[2:], 16) if name[1:2] in "xX" else int(name[1:])
                return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
            except ValueError:
                return m[0]
        return ENTITIES.get(name.lower(), m[0])

    return re.sub(r"&(#[xX]?[0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,11});", one, s)


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s>/]*)[^>]{0,4096}>?|<([A-Za-z][^\s>/]*)((?:[^>\"']|\"[^\"]{0,4096}\"|'[^']{0,4096}'){0,4096})>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def parse(html: str) -> Node:
    """A tree of whatever is there: unclosed and misplaced tags are taken as browsers take them, a stray `<` is text."""
    root = Node("#root")
    here, at, depth = root, 0, {id(root): 0}

    def text(s: str) -> None:
        if s:
            here.children.append(s)

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is not None:
            text(m[1])
        elif m[2]:
            name, up = m[2].lower(), here
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
        elif m[3]:
            name = m[3].lower()
            while here.parent is not None and name in CLOSED_BY.get(here.tag, ()):
                here = here.parent
            if depth[id(here)] >= MAX_DEPTH and name not in RAW:
                continue  # what nests deeper counts as content of the element it is in
            node = Node(name, {a[1].lower(): decode_entities(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[4] or "")}, parent=here)
            here.children.append(node)
            depth[id(node)] = depth[id(here)] + 1
            if name in RAW and not (m[4] or "").endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                node.children.append(html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
            elif name not in VOID and not (m[4] or "").endswith("/"):
                here = node
    return root


def own_text(node: Node | str) -> str:
    return decode_entities(node) if isinstance(node, str) else "".join(map(own_text, node.children))


def is_boilerplate(node: Node) -> bool:
    if node.tag in DROP_TAGS or node.attrs.get("role", "").lower() in DROP_ROLES or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    return node.tag not in ("html", "body", "main", "article") and any(BOILERPLATE.search(node.attrs.get(a, "")) for a in ("class", "id"))


def prune(node: Node) -> None:
    """Drops boilerplate; a part with very much text stays, unless it is of a kind that holds no text for readers."""
    kept = []
    for c in node.children:
        if isinstance(c, Node):
            if is_boilerplate(c) and (c.tag in DROP_TAGS or len(own_text(c)) < KEEP_CHARS):
                continue
            prune(c)
        kept.append(c)
    node.children = kept


@dataclass
class Stats:
    chars: int = 0
    marks: int = 0
    linked: int = 0
    prose: int = 0
    paragraphs: int = 0


def measure(node: Node, out: dict[int, Stats], in_link: bool = False) -> Stats:
    s = Stats()
    for c in node.children:
        if isinstance(c, str):
            t = " ".join(decode_entities(c).split())
            s.chars += len(t)
            s.marks += len(PUNCTUATION.findall(t))
            s.linked += len(t) if in_link else 0
        else:
            x = measure(c, out, in_link or c.tag == "a")
            for f in ("chars", "marks", "linked", "prose", "paragraphs"):
                setattr(s, f, getattr(s, f) + getattr(x, f))
    if node.tag == "p" and s.chars:
        s.prose, s.paragraphs = s.chars, s.paragraphs + 1
    out[id(node)] = s
    return s


def score(node: Node, s: Stats) -> float:
    """Length, paragraphs, density of marks and hints speak for a candidate, links against it."""
    if not s.chars:
        return 0.0
    link = s.linked / s.chars
    hint = any(HINT.search(node.attrs.get(a, "")) for a in ("class", "id"))
    base = min(s.chars, 40000) / 25 + min(s.paragraphs, 300) * 12 + min(s.marks / s.chars / 0.05, 1.5) * 200 + s.prose / s.chars * 250 + (400 if hint else 0)
    return (base - link * 1200) * (1 - link)


CANDIDATES = {"article", "main", "section", "div", "td", "body"}


def candidates(root: Node) -> list[tuple[float, int, Node]]:
    stats: dict[int, Stats] = {}
    measure(root, stats)
    total: dict[int, float] = {}
    nodes: list[Node] = []

    def visit(node: Node) -> None:
        for c in node.children:
            if isinstance(c, Node):
                visit(c)
        if node.tag in CANDIDATES and stats[id(node)].chars:
            nodes.append(node)
            own = score(node, stats[id(node)])
            total[id(node)] = total.get(id(node), 0.0) + own
            up = node.parent
            while up is not None and up.tag not in CANDIDATES:
                up = up.parent
            if up is not None:
                total[id(up)] = total.get(id(up), 0.0) + 0.4 * own

    visit(root)
    ranked = [(total[id(n)], stats[id(n)].chars, n) for n in nodes]
    return sorted(ranked, key=lambda x: (-x[0], -x[1]))[:MAX_CANDIDATES]


def render(node: Node) -> str:
    """Plain text: blocks on lines of their own, list marks, table cells set apart by bars."""
    out: list[str] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", decode_entities(c)))
            elif c.tag == "br":
                out.append("\n")
            elif c.tag in ("td", "th"):
                walk(c)
                out.append(" | ")
            elif c.tag == "tr":
                out.append("\n")
                walk(c)
                out.append("\n")
            elif c.tag == "li":
                out.append("\n")
                walk(c)
            elif c.tag in BLOCKS:
                out.append("\n\n")
                walk(c)
                out.append("\n\n")
            else:
                walk(c)

    walk(node)
    lines = [re.sub(r"[ \t]+", " ", x).strip().removesuffix("|").strip() for x in "".join(out).split("\n")]
    lines = [x for x in lines if not x or re.search(r"\w", x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(drop_repeated_tail(lines))).strip()


def drop_repeated_tail(lines: list[str]) -> list[str]:
    """Lines of six characters or more that repeat an earlier one, in the last quarter or the last five lines."""
    start, seen, out = len(lines) - max(5, -(-len(lines) // 4)), set(), []
    for i, x in enumerate(lines):
        if i >= start and len(x) >= 6 and x in seen:
            continue
        seen.add(x)
        out.append(x)
    return out


def densest(root: Node) -> str:
    """The run of blocks with the largest sum of text density above LEAST_DENSITY, weighted by length."""
    blocks: list[tuple[str, float]] = []

    def visit(n: Node) -> None:
        inner = [c for c in n.children if isinstance(c, Node) and c.tag in BLOCKS]
        if inner:
            for c in inner:
                visit(c)
        else:
            stats: dict[int, Stats] = {}
            s = measure(n, stats)
            if s.chars:
                blocks.append((render(n), ((1 - s.linked / s.chars) * min(1.0, s.chars / 80) - LEAST_DENSITY) * s.chars))

    visit(root)
    best, cur, at, span = 0.0, 0.0, 0, (0, 0)
    for i, (_, v) in enumerate(blocks):
        if cur <= 0:
            cur, at = 0.0, i
        cur += v
        if cur > best:
            best, span = cur, (at, i + 1)
    return "\n\n".join(t for t, _ in blocks[span[0] : span[1]])


def find(node: Node, test) -> Node | None:
    for c in node.children:
        if isinstance(c, Node):
            got = c if test(c) else find(c, test)
            if got is not None:
                return got
    return None


def title_of(root: Node, content: Node | None) -> str:
    one = lambda n: " ".join(own_text(n).split()) if n is not None else ""
    inside = one(find(content, lambda n: n.tag == "h1")) if content is not None else ""
    meta = find(root, lambda n: n.tag == "meta" and n.attrs.get("property", n.attrs.get("name", "")).lower() in ("og:title", "twitter:title"))
    page = re.split(r"\s+[|_—–-]\s+", one(find(root, lambda n: n.tag == "title")))[0]
    return inside or one(find(root, lambda n: n.tag == "h1")) or (meta.attrs.get("content", "").strip() if meta else "") or page


def extract(html: str | None) -> dict:
    """text, title, strategy (passthrough, candidate-scoring, semantic, density, body) and warnings; never raises."""
    src = html or ""
    if not re.search(r"<[a-zA-Z!/?][^>]*>", src):
        head = re.search(r"(?m)^#\s+(.+)$", src)
        return {"text": src.strip(), "title": head[1].strip() if head else "", "strategy": "passthrough", "warnings": []}
    root = parse(src)
    full = title_root = parse(src)
    prune(root)
    ranked = candidates(root)
    body = find(root, lambda n: n.tag == "body") or root
    choices = [("candidate-scoring", ranked[0][2])] if ranked and ranked[0][0] > 0 else []
    semantic = find(root, lambda n: n.tag in ("article", "main") or n.attrs.get("role") == "main")
    choices += [("semantic", semantic)] if semantic is not None else []
    for strategy, node in choices:
        text = render(node)
        if len(text) >= MIN_TEXT:
            return {"text": text, "title": title_of(title_root, node), "strategy": strategy, "warnings": []}
    dense, whole = densest(body), render(body)
    text, strategy = (dense, "density") if len(dense) >= MIN_TEXT else (whole, "body")
    if not text:
        text, strategy = render(find(full, lambda n: n.tag == "body") or full), "document"
    return {"text": text, "title": title_of(title_root, None), "strategy": strategy, "warnings": ["little text found"] if len(text) < MIN_TEXT else []}
