"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks."""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import arrow_map

#: Labelled pages the field is trained on, made by `labelled_page`, and steps of the training.
PAGES, STEPS = 900, 150
SEED = 5

# Element names of HTML by what they do to the text around them.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp noembed noframes plaintext head datalist".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "thead": {"td", "th", "tr", "thead", "tbody"}, "tbody": {"td", "th", "tr", "thead", "tbody"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
SCOPES = frozenset("ul ol dl table select div section article body html td th button".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME = re.compile(r"[a-z]+")
RIGHTS = re.compile(r"©|\(c\)|copyright|all rights", re.I)
QUOTED = re.compile(r"\"[^\"]*\"?|'[^']*'?")
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
UNSHOWN = re.compile(r"style\s*=\s*(?:\"[^\"]*|'[^']*|)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: How reader comments are told where nothing is named so: by their number, and by when they were written.
COUNTED = re.compile(r"^\W*\d+ (?:comments?|replies|responses|reviews?|reactions?)\b|^(?:comments?|replies|responses|reviews?)\W*\d*\W*$", re.I)
AGO = re.compile(r"\b(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago\b", re.I)


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    marks: frozenset[str]
    linked: int


@dataclass(slots=True)
class _Open:
    tag: str
    marks: frozenset[str]
    unseen: bool


@functools.lru_cache(maxsize=10_000)
def _named(word: str) -> tuple[str, ...]:
    """Marks of a word of a class, id or role: itself, and a usual name that it holds."""
    held = next((w for w in ROOTS if w in word and w != word), None)
    return (f"named:{word}", f"named:{held}") if held else (f"named:{word}",)


def _hidden(attributes: str) -> bool:
    low = attributes.lower()
    return "hidden" in low and (UNSHOWN.search(attributes) is not None or HIDDEN.search(QUOTED.sub("", attributes)) is not None) or "none" in low and UNSHOWN.search(attributes) is not None


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order: text between the borders of block elements, with the marks of its ancestors (their
    tags, and words of their class, id and role). known: the marks worth keeping; others are dropped at once, so that
    deeply nested pages take time in proportion to their length."""
    out: list[Block] = []
    stack = [_Open("", frozenset(), False)]
    count: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = next((o for o in reversed(stack) if o.tag in BLOCK), stack[0])
                out.append(Block(text, top.tag, top.marks, linked))
            parts.clear()
        linked = 0

    def pop() -> None:
        count[stack.pop().tag] -= 1

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:2] not in ("<!", "<?") and not stack[-1].unseen:
                text = html.unescape(m[0])
                parts.append(text)
                if count["a"]:
                    linked += len(text)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if count[tag] > 0 and tag not in VOID:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in BLOCK:
            flush()
        if tag == "br":
            parts.append(" ")
        if tag in ENDS_P and count["p"] > 0:
            depth = len(stack) - 1
            while depth and stack[depth].tag not in SCOPES and stack[depth].tag != "p":
                depth -= 1
            if stack[depth].tag == "p":
                while len(stack) > depth:
                    pop()
        if (closed := CLOSES.get(tag)) and tag != "p":
            depth = len(stack) - 1
            while depth and stack[depth].tag not in SCOPES and stack[depth].tag not in closed:
                depth -= 1
            if stack[depth].tag in closed:
                while len(stack) > depth:
                    pop()
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        marks = {f"in:{tag}"} if tag in BLOCK or tag == "ins" else set()
        for a in ATTRIBUTE.finditer(m[3]):
            for w in NAME.findall(a[2].lower()):
                marks.update(_named(w))
        if known is not None:
            marks &= known
        above = stack[-1]
        stack.append(_Open(tag, above.marks | marks if not marks <= above.marks else above.marks, above.unseen or tag in UNSEEN or bool(m[3]) and _hidden(m[3])))
        count[tag] += 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return out


# Usual names of the parts of pages, by tag, class or id.
AROUND = {
    "menu": ("nav", "nav.main-nav", "div.menu", "div#navigation", "ul.nav", "div.navbar", "div.breadcrumb", "div.breadcrumbs", "ul.menu", "div.pagination", "div.tabs", "div.toc", "menu", "div"),
    "header": ("header", "header.site-header", "div.header", "div#masthead", "div.topbar", "div.top", "div.logo", "div.branding", "div.tagline", "div"),
    "footer": ("footer", "footer.site-footer", "div.footer", "div#footer", "div#colophon", "div.copyright", "div.legal", "div.bottom", "div"),
    "sidebar": ("aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related-posts", "div.recommended", "div.trending", "div.popular", "div.side", "div.archive", "div.tags", "aside.rail"),
    "notice": ("div.notice", "div.cookie", "div.cookie-banner", "div#consent", "div.alert", "div.popup", "div.modal", "div.overlay", "div.gdpr", "div.banner", "div.message", "div.warning", "div.disclaimer", "div.paywall", "div.privacy", "dialog"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.sponsor", "ins.adsbygoogle", "div.promo", "section.promotion", "div#ad-slot", "div.commercial", "aside.ad", "div.offer", "p.ad", "div.adbox"),
    "form": ("form", "form.search", "form#login", "div.newsletter", "div.subscribe", "div.signup", "div.login", "form.contact", "fieldset", "search"),
    "comments": ("section.comments", "div#comments", "div.comments", "ol.commentlist", "ul.comment-list", "div.comment", "div.replies", "div.discussion", "section.responses", "div.feedback", "div.reviews", "div#disqus"),
    "table": ("td",),
    "share": ("div.share", "div.social", "ul.sharing", "div.toolbar", "div.actions", "div.author-bio", "div.meta"),
}
ARTICLE = ("article", "article", "article", "article", "article.post", "main", "div.content", "div.article-body", "div.entry-content", "div.post", "div#main", "section.story", "div#content", "div.text", "main.main-content", "div", "div", "div", "td", "div.article", "section")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LENGTHS = (2, 4, 8, 16, 32, 64)


def _marks(names: tuple[str, ...]) -> set[str]:
    return {m for n in names for m in ([f"in:{n}"] if n.isalpha() else [f"named:{w}" for w in NAME.findall(re.split(r"[.#]", n, maxsplit=1)[1])])} - {"in:div", "in:section", "in:td", "in:p"}


#: Marks of the parts around an article, and of articles.
AMONG = _marks(ARTICLE)
AMID = frozenset(set().union(*map(_marks, AROUND.values())) | {"in:dialog", "in:ins", "in:button", "in:select"}) - AMONG


#: Usual names that are looked for within longer words, the longest first.
ROOTS = tuple(sorted({m.removeprefix("named:") for m in AMID | AMONG if m.startswith("named:") and len(m) >= 11}, key=lambda w: (-len(w), w)))


def features(all_blocks: list[Block]) -> list[list[str]]:
    """What the field sees of each block."""
    out = []
    n = len(all_blocks)
    for i, b in enumerate(all_blocks):
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        f = ["bias", f"tag:{b.tag}", f"words:{sum(words >= k for k in LENGTHS)}", "linked:" + ("all" if share > 0.8 else "much" if share > 0.3 else "some" if share > 0 else "none"), *b.marks]
        f.append("stops" if b.text[-1] in ".!?:;\"')…”»" else "open")
        amid = bool(b.marks & AMID)
        f.append(("amid:" if amid else "clear:") + ("article" if b.marks & AMONG else b.tag))
        f.append(f"{b.tag}:{f[3]}")
        if told := RIGHTS.search(b.text):
            f += ["rights", f"rights:{b.tag}", "rights:all" if told[0].lower() == "all rights" else "rights:whose"]
        if words < 12 and COUNTED.search(b.text):
            f.append("counted")
        if words < 16 and AGO.search(b.text):
            f.append("ago")
        if b.tag in HEADINGS and i + 1 < n and all_blocks[i + 1].linked > 0.8 * len(all_blocks[i + 1].text):
            f.append("leads:links")
        if "," in b.text:
            f.append("comma")
        if n > 8 and i < 2:
            f.append("first")
        if n > 8 and i >= n - 2:
            f.append("last")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of two labels, 0: not of the article, 1: of the article."""

    weights: dict[str, tuple[float, float]]
    moves: list[list[float]]
    start: list[float]
    known: frozenset[str] = field(default_factory=frozenset)

    def decode(self, all_blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not all_blocks:
            return []
        (a, b), (c, d) = self.moves
        x, y = self.start
        back: list[tuple[int, int]] = []
        get, none = self.weights.get, (0.0, 0.0)
        for i, fs in enumerate(features(all_blocks)):
            u = v = 0.0
            for name in fs:
                w = get(name, none)
                u += w[0]
                v += w[1]
            if i:
                back.append((0 if x + a >= y + c else 1, 0 if x + b >= y + d else 1))
                x, y = max(x + a, y + c) + u, max(x + b, y + d) + v
            else:
                x, y = x + u, y + v
        label = 0 if x >= y else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "", self.known)
        return "\n".join(b.text for b, keep in zip(found, self.decode(found)) if keep)


WITHIN = ("p", "p", "p", "p", "p", "h2", "h3", "ul", "ol", "blockquote", "pre", "table", "figure", "div", "dl")


def _open(name: str) -> tuple[str, str]:
    tag, _, a = name.partition("." if "." in name else "#")
    return f"<{tag}{f' class="{a}"' if '.' in name else f' id="{a}"' if a else ''}>", f"</{tag}>"


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A made-up page and the labels of its blocks: an article amid some of the usual other parts, in a usual order."""
    out: list[str] = []
    labels: list[int] = []

    def words(a: int, b: int, stop: float = 0.9) -> str:
        n = max(a, min(b, int(r.lognormvariate((a + b) ** 0.5 / 3, 0.8))))
        w = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 9))) for _ in range(n)]
        if n > 4:
            w = [x + ("," if r.random() < 0.08 else "") for x in w[:-1]] + w[-1:]
        return " ".join(w).capitalize() + (r.choice("...!?") if r.random() < stop else "")

    def put(tag: str, text: str, label: int) -> None:
        out.append(f"<{tag}>{text}</{tag}>" if tag else text)
        labels.append(label)

    def link(text: str) -> str:
        return f'<a href="/x">{text}</a>'

    def around(kind: str) -> None:
        name = r.choice(AROUND[kind])
        if kind == "comments" and r.random() < 0.25 or kind == "sidebar" and r.random() < 0.15:
            name = "div"
        a, b = _open(name)
        tag = a[1:].split(" ")[0].rstrip(">")
        out.append(a)
        if kind == "menu":
            for _ in range(r.randint(2, 9)):
                put("li" if tag in ("ul", "menu") or r.random() < 0.7 else "div", link(words(1, 3, 0.1)) if name == "div" or r.random() < 0.8 else words(1, 20, 0.4), 0)
        elif kind == "header":
            for _ in range(r.randint(1, 3)):
                put(r.choice(("h1", "h2", "p", "div")), words(1, 30, 0.5) if name != "div" else link(words(1, 4, 0.1)), 0)
        elif kind == "footer":
            for _ in range(r.randint(1, 3)):
                put(r.choice(("p", "div")), r.choice(("&copy; ", "Copyright 2020 ", "")) + words(2, 50, 0.7) if name != "div" else "&copy; " + words(2, 8), 0)
            if name != "div" and r.random() < 0.5:
                out.append("&copy; " + words(1, 30, 0.7) + " &middot; " + words(1, 50))
                labels.append(0)
        elif kind == "table":
            for _ in range(r.randint(1, 2)):
                put("", " ".join(link(words(1, 2, 0)) for _ in range(r.randint(1, 6))), 0)
                out.append("</td><td>")
        elif kind == "sidebar" and name in ("div", "td"):
            put(r.choice(("h2", "h3", "h4")), words(1, 3, 0), 0)
            for _ in range(r.randint(2, 6)):
                put(r.choice(("li", "p", "div")), link(words(2, 9, 0.2)), 0)
        elif kind == "sidebar":
            for _ in range(r.randint(1, 6)):
                put(r.choice(("li", "p", "h3", "div")), link(words(2, 9, 0.2)) if r.random() < 0.6 else words(2, 60, 0.7), 0)
        elif kind in ("notice", "advert"):
            for _ in range(r.randint(1, 3)):
                if tag == "p" or r.random() < 0.4:
                    out.append(words(2, 30))
                    labels.append(0)
                    break
                put(r.choice(("p", "div", "h3")), words(2, 40), 0)
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                put(r.choice(("label", "p", "button", "legend", "option", "div")), words(1, 30, 0.4), 0)
        elif kind == "comments" and name in ("div", "ol"):
            put(r.choice(("h2", "h3", "h4", "p")), r.choice((f"{r.randint(1, 40)} {r.choice(('comments', 'Comments', 'replies', 'responses'))}", f"Comments ({r.randint(1, 40)})", "Comments")), 0)
            for _ in range(r.randint(1, 5)):
                said = f"{words(1, 2, 0)} {r.randint(1, 20)} {r.choice(('days', 'hours', 'weeks', 'minutes'))} ago"
                put(r.choice(("p", "div", "h4", "li")), said, 0)
                for _ in range(r.randint(1, 2)):
                    put("p", words(2, 50), 0)
        elif kind == "comments":
            put(r.choice(("h2", "h3")), words(1, 3, 0), 0)
            for _ in range(r.randint(1, 6)):
                item = r.choice(("div.comment", "li.comment", "article.comment", "li", "div", "div.reply"))
                c, d = _open(item)
                out.append(c)
                put(r.choice(("div", "p", "h4")), words(1, 3, 0), 0)
                for _ in range(r.randint(1, 3)):
                    put("p", words(3, 60), 0)
                out.append(d)
        else:
            for _ in range(r.randint(1, 4)):
                put(r.choice(("li", "p", "div")), link(words(1, 3, 0)) if r.random() < 0.6 else words(1, 15, 0.5), 0)
        out.append(b)

    def article() -> None:
        name = r.choice(ARTICLE)
        a, b = _open(name)
        nested = r.random() < 0.3
        out.append(("<main>" if nested else "") + ("<table><tr>" if a == "<td>" else "") + a)
        if r.random() < 0.85:
            put("h1", words(2, 14, 0.5), 1)
        for _ in range(r.randint(1, 14)):
            kind = r.choice(WITHIN)
            if kind in ("ul", "ol"):
                out.append(f"<{kind}>")
                for _ in range(r.randint(1, 5)):
                    put("li", words(2, 30, 0.6), 1)
                out.append(f"</{kind}>")
            elif kind == "blockquote":
                out.append("<blockquote>")
                put("p", words(5, 60), 1)
                out.append("</blockquote>")
            elif kind == "table":
                out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(2):
                        put(r.choice(("td", "td", "th")), words(1, 6, 0.1), 1)
                    out.append("</tr>")
                out.append("</table>")
            elif kind == "figure":
                out.append("<figure><img src=x>")
                put("figcaption", words(2, 16, 0.7), 1)
                out.append("</figure>")
            elif kind == "dl":
                out.append("<dl>")
                put("dt", words(1, 3, 0), 1)
                put("dd", words(3, 30), 1)
                out.append("</dl>")
            elif kind in ("h2", "h3"):
                put(kind, words(1, 9, 0.3), 1)
            else:
                text = words(1, 110, 0.95) if r.random() < 0.96 else "All rights reserved."
                if r.random() < 0.15:
                    text += " " + link(words(1, 3, 0)) + " " + words(1, 8)
                put(kind, text, 1)
            if r.random() < 0.06:
                around(r.choice(("advert", "sidebar", "share", "notice", "form")))
        if r.random() < 0.12:
            around("comments")
        out.append(b + ("</tr></table>" if a == "<td>" else "") + ("</main>" if nested else ""))

    if r.random() < 0.12:  # a page that is a table
        out.append("<table><tr>")
        around("table")
        out.append("</tr><tr><td>")
        article()
        out.append("</td>")
        if r.random() < 0.6:
            out.append("<td>")
            around("sidebar")
            out.append("</td>")
        out.append("</tr><tr><td>")
        put("", r.choice(("&copy; 2020 ", "Copyright 2020 ")) + words(1, 5, 0), 0)
        out.append("</td></tr></table>")
        return f"<html><head><title>x</title></head><body>{''.join(out)}</body></html>", labels
    parts = ["header", "menu", "notice", "advert", "form", "sidebar"]
    r.shuffle(parts)
    for kind in parts[: r.randint(0, 5)]:
        around(kind)
    article()
    parts = ["comments", "sidebar", "share", "advert", "form", "menu", "notice"]
    r.shuffle(parts)
    for kind in parts[: r.randint(0, 4)]:
        around(kind)
    if r.random() < 0.85:
        around("footer")
    return f"<html><head><title>x</title></head><body>{''.join(out)}</body></html>", labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[str, list[int]]], steps: int = STEPS, ridge: float = 5e-5) -> Field:
    """Maximum likelihood by gradient steps (Adam), all pages at once; forward and backward sums run along the blocks."""
    seqs = []
    for page, labels in pages:
        found = blocks(page)
        if len(found) == len(labels):
            seqs.append((features(found), labels))
    counts = Counter(f for fs, _ in seqs for x in fs for f in set(x))
    names = sorted(f for f, n in counts.items() if n >= 3)
    place = {f: i for i, f in enumerate(names)}
    long = max(len(y) for _, y in seqs)
    x = np.zeros((long, len(seqs), len(names)), np.float32)
    y, real = np.zeros((long, len(seqs)), int), np.zeros((long, len(seqs)), bool)
    for s, (fs, labels) in enumerate(seqs):
        for t, (f, label) in enumerate(zip(fs, labels)):
            x[t, s, [place[k] for k in f if k in place]] = 1
            y[t, s], real[t, s] = label, True
    flat, hot = x.reshape(-1, len(names)), np.eye(2)[y] * real[..., None]
    pairs = np.einsum("tsa,tsb->ab", hot[:-1], hot[1:])
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    total = real.sum()
    for k in range(1, steps + 1):
        e = (flat @ w.astype(np.float32)).reshape(long, len(seqs), 2).astype(float)
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, long):
            new = _log_sum(ahead[t - 1][:, :, None] + moves[None], 1) + e[t]
            ahead[t] = np.where(real[t][:, None], new, ahead[t - 1])
        for t in range(long - 2, -1, -1):
            new = _log_sum(moves[None] + (e[t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(real[t + 1][:, None], new, 0)
        z = _log_sum(ahead[-1], 1)
        p = np.exp(ahead + behind - z[None, :, None]) * real[..., None]
        joint = np.exp(ahead[:-1][..., :, None] + moves[None, None] + (e[1:] + behind[1:])[..., None, :] - z[None, :, None, None]) * real[1:][..., None, None]
        slopes = [flat.T @ (hot - p).reshape(-1, 2).astype(np.float32) / total - ridge * w, (pairs - joint.sum(axis=(0, 1))) / total]
        for i, (v, g) in enumerate(zip((w, moves), slopes)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * g * g
            v += 0.15 * (state[2 * i] / (1 - 0.9**k)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**k)) + 1e-8)
    return Field({f: (float(a), float(b)) for f, (a, b) in zip(names, w)}, moves.tolist(), [0.0, 0.0], frozenset({f for f in names if f.startswith(("in:", "named:"))} | AMONG | AMID))


@functools.cache
def trained(pages: int = PAGES, seed: int = SEED) -> Field:
    r = random.Random(seed)
    return train([labelled_page(r) for _ in range(pages)])


def main_texts(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every row: the blocks that the field gives to the article, each with its white space made
    single spaces, joined by line breaks. Null and blockless pages have an empty text; repeated rows give repeated rows;
    nulls in id and url stay; other columns are ignored; an empty table gives no rows. Whole pages are read, whatever
    their length."""

    def step(batch: pa.RecordBatch) -> dict:
        texts = [model.main_text(x) for x in batch.column(2).to_pylist()]
        return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n": [len(x) for x in texts]}

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    done = arrow_map(rows, step, "id long, url string, text string, n long", {"id": pa.int64(), "url": pa.string(), "text": pa.string(), "n": pa.int64()})
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.col("n").alias("n_chars"))
