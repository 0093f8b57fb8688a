"""Main text of web pages by a recurrent block labeller.

A tolerant scanner splits a page into leaf blocks: stretches of text between block-level boundaries,
each with its path of open tags. Every block becomes a vector of hashed tag-path tokens, hashed words
and a few shape measures. A bidirectional LSTM in numpy reads the whole sequence of a page, so every
block is labelled in the context of all others; blocks labelled as article text are joined.

The labeller is trained here, once a driver process, on pages that a seeded generator invents in many
layouts (``TRAIN_PAGES`` of them), and is broadcast: its size is fixed by its shape.

Defined results: a null or empty page gives empty text; references are decoded; white space inside a
block becomes one space; a page without article text gives an empty text; pages are read whole;
repeated rows each get their own row; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tune

#: Elements whose text is never shown, elements that end a block, elements without an end tag.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html label legend li main menu nav ol option p pre section summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these kinds: paragraphs end at any block, items at the next item.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html div article section aside nav main form select header footer".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|([^<]++|<)",
    re.DOTALL,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_WORDS = re.compile(r"\w+")
_MARKS, _DIGITS = re.compile(r"[.,;:!?]"), re.compile(r"\d")


@dataclass
class Block:
    """A leaf block: its text, the tag it is in, the share of linked text; of the path of open tags the
    sums of hashed tokens, their number, and the innermost (tokens, outer) node."""

    text: str
    tag: str
    linked: float
    sums: np.ndarray
    depth: int
    node: tuple | None

    @property
    def path(self) -> tuple[str, ...]:
        """The tokens of all open tags, innermost first."""
        out, node = [], self.node
        while node is not None:
            out += node[0]
            node = node[1]
        return tuple(out)


PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN_DIM = 160, 64, 10, 24
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM


class _Slots(dict):
    """The slot of each word."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        at = self[word] = xxhash.xxh32_intdigest(word) % self.size
        return at


_path_slot, _word_slot = _Slots(PATH_DIM), _Slots(WORD_DIM)


class _Path:
    """The open tags of a page: their hashed tokens as a running sum, and how many of each tag are open."""

    def __init__(self):
        self.stack: list[tuple[str, list[int], tuple | None]] = []
        self.node: tuple | None = None
        self.open: dict[str, int] = {}
        self.blocks: list[str] = []
        self.sum = np.zeros(PATH_DIM, np.float32)
        self.depth = 0

    def push(self, tag: str, tokens: tuple[str, ...]) -> None:
        at = [_path_slot[x] for x in tokens]
        for k in at:
            self.sum[k] += 1
        self.depth += len(at)
        self.stack.append((tag, at, self.node))
        self.node = (tokens, self.node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in BLOCK:
            self.blocks.append(tag)

    def pop(self) -> None:
        tag, at, self.node = self.stack.pop()
        for k in at:
            self.sum[k] -= 1
        self.depth -= len(at)
        self.open[tag] -= 1
        if tag in BLOCK:
            self.blocks.pop()

    def has(self, tags: tuple[str, ...]) -> bool:
        return any(self.open.get(t) for t in tags)


def _path_tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "style":
                if "none" in value and "display" in value.replace(" ", "") or "hidden" in value:
                    out.append("hidden")
            elif name in ("hidden", "aria-hidden"):
                if value != "false":
                    out.append("hidden")
            else:
                for x in _PART.findall(value):
                    out.append(f".{x}")
                    if len(x) > 4:  # "comments", "commentlist" and "comment" have a beginning in common
                        out.append(f".{x[:4]}*")
    return tuple(out)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order; its time grows with the page's length, however deep it nests."""
    out: list[Block] = []
    path = _Path()
    text: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        joined = " ".join(html.unescape("".join(text)).split()) if text else ""
        if joined and not path.open.get("head"):
            out.append(Block(joined, path.blocks[-1] if path.blocks else "", linked / max(total, 1), path.sum.copy(), path.depth, path.node))
        text.clear()
        linked = total = 0

    def close(upto: int) -> None:
        blocks = len(path.blocks)
        if blocks and any(x[0] in BLOCK for x in path.stack[upto:]):
            flush()
        while len(path.stack) > upto:
            path.pop()

    if not page:
        return out
    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        if m is None:  # a tag that never closes: the rest is markup
            break
        pos = m.end()
        if m[7] is not None:
            text.append(m[7])
            n = len(m[7])
            total += n
            if path.open.get("a"):
                linked += n
            continue
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if end:
            if path.open.get(tag):
                i = len(path.stack) - 1
                while path.stack[i][0] != tag:
                    i -= 1
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in HIDDEN:
            if attrs.rstrip().endswith("/"):
                continue
            if tag == "head":  # only its hidden children and metadata follow; its text is dropped
                path.push(tag, ("head",))
                continue
            stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, pos)
            pos = stop.end() if stop else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag == "body" and path.open.get("head"):
                while path.open["head"]:
                    path.pop()
            ends = ENDS.get(tag, ()) + ("p",)
            if path.has(ends):
                for i in range(len(path.stack) - 1, -1, -1):
                    if path.stack[i][0] in ends:
                        close(i)
                        break
                    if path.stack[i][0] in SCOPE:
                        break
        if not attrs.rstrip().endswith("/") or tag in BLOCK:
            path.push(tag, _path_tokens(tag, attrs))
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A vector for each block, over all of its words."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    slot = _word_slot.__getitem__
    for i, b in enumerate(blocks):
        row = out[i]
        row[:PATH_DIM] = b.sums
        row[_path_slot["leaf:" + b.tag]] += 1.0
        words = _WORDS.findall(b.text.lower())
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(np.fromiter(map(slot, words), np.int64, len(words)), minlength=WORD_DIM)
        n = len(b.text)
        row[PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked, len(_MARKS.findall(b.text)) / n, len(_DIGITS.findall(b.text)) / n,
            b.text[-1] in ".!?", b.text[0].isupper(), i / len(blocks), np.log1p(b.depth) / 3, b.tag.startswith("h") and b.tag[1:].isdigit(),
        )
    np.minimum(out[:, :PATH_DIM], 2.0, out=out[:, :PATH_DIM])
    norm = np.linalg.norm(out[:, PATH_DIM : PATH_DIM + WORD_DIM], axis=1, keepdims=True)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] /= np.maximum(norm, 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with one logit a block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN_DIM
        self.p = {}
        for d in ("f", "b"):
            self.p["W" + d] = (rng.normal(size=(INPUT, 4 * h)) * 0.15).astype(np.float32)
            self.p["U" + d] = (rng.normal(size=(h, 4 * h)) * 0.15).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.p["c" + d] = bias
        self.p["V"] = (rng.normal(size=2 * h) * 0.2).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (batch, time, h) in one direction, with what the way back needs."""
        n, t, _ = x.shape
        h = HIDDEN_DIM
        pre = x @ self.p["W" + d] + self.p["c" + d]
        s = c = np.zeros((n, h), np.float32)
        out, kept = np.zeros((n, t, h), np.float32), [None] * t
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = pre[:, k] + s @ self.p["U" + d]
            i, f, o = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h])
            g = np.tanh(a[:, 3 * h :])
            m = mask[:, k, None]
            fresh = f * c + i * g
            tc = np.tanh(fresh)
            kept[k] = (s, c, i, f, o, g, tc)
            c = np.where(m, fresh, c)
            s = np.where(m, o * tc, s)
            out[:, k] = s
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]
        return np.concatenate([f, b], axis=2) @ self.p["V"] + self.p["v"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        h = HIDDEN_DIM
        runs = {d: self._run(x, mask, d) for d in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ self.p["V"] + self.p["v"])
        n = max(mask.sum(), 1)
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        delta = (mask * (p - y) / n).astype(np.float32)
        grad = {"V": np.einsum("nt,nth->h", delta, both), "v": np.array([delta.sum()], np.float32)}
        for j, d in enumerate(("f", "b")):
            down = delta[:, :, None] * self.p["V"][j * h : (j + 1) * h]
            ds = dc = np.zeros((x.shape[0], h), np.float32)
            da = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dU = np.zeros_like(self.p["U" + d])
            times = range(x.shape[1])
            for k in reversed(times) if d == "f" else times:
                s, c, i, f, o, g, tc = runs[d][1][k]
                m = mask[:, k, None]
                full = ds + down[:, k]
                dh, carry = full * m, full * (1 - m)
                dcell = (dc + dh * o * (1 - tc * tc)) * m
                a = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                da[:, k] = a
                dU += s.T @ a
                ds = a @ self.p["U" + d].T + carry
                dc = dcell * f + dc * (1 - m)
            flat = da.reshape(-1, 4 * h)
            grad["W" + d] = x.reshape(-1, INPUT).T @ flat
            grad["U" + d] = dU
            grad["c" + d] = flat.sum(axis=0)
        return loss, grad

    def label(self, pages: list[list[Block]], batch_blocks: int = 20_000) -> list[np.ndarray]:
        """For each page the probability of each block to be article text."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= batch_blocks:
                stop += 1
            x, mask = _padded([features(pages[i]) for i in order[at:stop]])
            p = _sigmoid(self.logits(x, mask))
            for row, i in enumerate(order[at:stop]):
                out[i] = p[row, : len(pages[i])]
            at = stop
        return out


def _padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, vectors))
    x, mask = np.zeros((len(vectors), t, INPUT), np.float32), np.zeros((len(vectors), t), np.float32)
    for i, v in enumerate(vectors):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
    return x, mask


#: Fixed words of the invented pages: furniture of the web in four languages, and names of its parts.
FURNITURE = (
    "home about contact login sign in register search menu privacy policy terms of service cookies accept all reject settings subscribe newsletter share tweet"
    " follow us copyright all rights reserved advertisement sponsored related posts read more next previous comments reply likes posted by tags archive sitemap"
    " startseite anmelden datenschutz impressum kontakt suche werbung kommentare teilen mehr lesen accueil connexion recherche publicité partager commentaires"
    " mentions légales inicio buscar acceder publicidad compartir comentarios aviso legal política de privacidad"
).split()
NAV = ("nav", "menu", "navbar", "topnav", "breadcrumbs", "breadcrumb", "navigation", "links")
HEAD = ("header", "masthead", "banner", "top", "site-header", "branding")
FOOT = ("footer", "bottom", "colophon", "site-footer", "legal", "copyright")
SIDE = ("sidebar", "aside", "widget", "related", "recommended", "rail", "trending", "popular")
ADS = ("ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement", "adslot")
NOTE = ("cookie", "consent", "notice", "modal", "popup", "newsletter", "gdpr", "alert", "overlay", "subscribe")
TALK = (
    "comments", "comment", "discussion", "replies", "respond", "disqus", "comment-list", "commentlist", "comments-area", "comment-section", "reader-comments", "user-comments", "responses",
    "feedback", "thread", "conversation", "reactions", "opinions", "talk", "guestbook", "disqus_thread", "kommentare", "commentaires", "comentarios", "post-comments", "readers", "discuss",
)
REMARK = ("comment", "reply", "comment-body", "response", "message", "remark", "comment-content", "comment-text", "kommentar", "commentaire", "comentario", "media-body", "user-post", "depth-1")
TALK_HEADS = (
    "comments", "3 comments", "12 responses", "leave a reply", "join the discussion", "what readers say", "reader comments", "discussion", "5 replies", "leave a comment",
    "kommentare", "schreibe einen kommentar", "commentaires", "laisser un commentaire", "comentarios", "deja un comentario", "2 thoughts on this post", "your comments",
)
TALK_LINES = ("reply", "report", "like", "share", "quote", "says:", "wrote:", "posted by", "log in to reply", "antworten", "répondre", "responder", "permalink", "show more comments")
BODY = ("content", "post", "entry", "article", "main", "story", "post-body", "entry-content", "text", "article-body")


def invent_page(rng: np.random.Generator) -> str:
    """A page of a random layout. Article blocks carry the marker U+E000, others U+E001."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    flip = lambda p: bool(rng.random() < p)
    syllables = [pick("bcdfghklmnprstvwz") + pick("aeiouéèäöüñ") + pick(["", "", "n", "r", "s"]) for _ in range(40)]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def words(low: int, high: int, furniture: float = 0.0) -> str:
        return " ".join(pick(FURNITURE) if flip(furniture) else word() for _ in range(int(rng.integers(low, high))))

    def sentence() -> str:
        return words(1, 16).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        out = " ".join(sentence() for _ in range(int(rng.choice([1, 1, 2, 4, 8]))))
        if flip(0.1):
            out = " ".join(w + pick(["###", "%%%", "&amp;&amp;", "***", "|"]) for w in out.split())
        if flip(0.2):
            out = f'{out} <a href="/{word()}">{words(1, 4)}</a> {words(1, 6)}.'
        return out

    good, bad = "\ue000", "\ue001"
    attr = lambda names: "" if flip(0.15) else f' {pick(["class", "class", "id"])}="{pick(names)}{pick(["", "", " box", " clearfix", "-1"])}"'
    link = lambda: f'<a href="/{word()}">{bad}{words(1, 4, pick([0, 0.3, 0.8]))}</a>'

    def listing() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 10)))) + "</ul>"

    def furniture_text() -> str:
        return bad + words(2, 20, pick([0, 0.2, 0.6])).capitalize() + pick([".", "", ""])

    def menu() -> str:
        return pick([f"<nav{attr(NAV) if flip(0.5) else ''}>{listing()}</nav>", f'<div class="{pick(NAV)}">{listing()}</div>', f'<ul class="{pick(NAV)}">' + listing()[4:]])

    def wrapped(tags: tuple[str, ...], names: tuple[str, ...], inner: str) -> str:
        tag = pick(tags)
        return f'<div class="{pick(names)}{pick(["", "", " wrap", "-box"])}">{inner}</div>' if tag == "div" else f"<{tag}{attr(names) if flip(0.5) else ''}>{inner}</{tag}>"

    def header() -> str:
        return wrapped(("header", "div"), HEAD, pick([f"<h1>{bad}{words(1, 4)}</h1>", f"<p>{furniture_text()}</p>", f"<a href='/'>{bad}{words(1, 3)}</a>"]) + (menu() if flip(0.5) else ""))

    def footer() -> str:
        return wrapped(("footer", "footer", "div"), FOOT, pick([furniture_text(), f"{bad}&copy; {word()}.example &middot; {words(2, 8)}.", f"<p>{furniture_text()}</p>{listing()}"]))

    def advert() -> str:
        return f'<div class="{pick(ADS)}">{pick([furniture_text(), f"<p>{furniture_text()}</p>", f"{bad}{sentence()} {sentence()}"])}</div>'

    def notice() -> str:
        return wrapped(("div", "div", "section", "aside"), NOTE, f"<p>{furniture_text()}</p>" + pick(["", f"<button>{bad}{words(1, 3, 0.5)}</button>"]))

    def side() -> str:
        return wrapped(("aside", "aside", "div"), SIDE, f"<h3>{bad}{words(1, 4, 0.3)}</h3>" + pick([listing(), f"<p>{bad}{prose()}</p>", f"<p>{furniture_text()}</p>"]))

    def form() -> str:
        return f'<form action="/{word()}"><label>{bad}{words(1, 4, 0.5)}</label><input type="text"><button>{bad}{words(1, 2, 0.5)}</button>' + pick(["", f"<p>{furniture_text()}</p>"]) + "</form>"

    def remark(named: bool) -> str:
        by = pick(["", f"<p>{bad}{word().capitalize()} {pick(['says:', 'wrote:', '', 'schrieb:', 'a dit :'])}</p>", f"<cite>{bad}{word().capitalize()}</cite>", f"<div><b>{bad}{word()}</b> {int(rng.integers(1, 28))} May 20{int(rng.integers(10, 25))}</div>", f"<h4>{bad}{word().capitalize()}</h4>"])
        said = pick([f"<p>{bad}{prose()}</p>", f"<p>{bad}{prose()}</p><p>{bad}{prose()}</p>", f"{bad}{prose()}", f"<div>{bad}{prose()}</div>"])
        after = pick(["", f"<a href='#'>{bad}{pick(TALK_LINES)}</a>", f"<p>{bad}{pick(TALK_LINES)} · {pick(TALK_LINES)}</p>"])
        tag = pick(("div", "li", "article", "section", "blockquote")) if named else pick(("div", "li", "p", "tr"))
        inner = f"<td>{by}{said}{after}</td>" if tag == "tr" else f"{by}{said}{after}"
        return f'<{tag}{attr(REMARK) if named else ""}>{inner}</{tag}>'

    def talk() -> str:
        named = flip(0.75)
        head = f"<h{pick('2334')}>{bad}{pick(TALK_HEADS).capitalize()}</h3>" if flip(0.85) or not named else f"<h3>{bad}{words(1, 3, 0.5)}</h3>"
        inner = head + "".join(remark(flip(0.8) if named else False) for _ in range(int(rng.integers(1, 6))))
        if flip(0.2):
            inner += f"<form><label>{bad}{pick(TALK_HEADS)}</label><textarea></textarea><button>{bad}{words(1, 2, 0.5)}</button></form>"
        if not named:
            return pick([f"<div>{inner}</div>", inner, f"<section>{inner}</section>", f"<table>{inner}</table>"])
        return wrapped(("div", "div", "section", "ol", "aside"), TALK, inner)

    def teasers() -> str:
        one = lambda: f'<article{attr(("teaser", "card", "item", "preview"))}><h3>{link()}</h3><p>{bad}{sentence()}</p></article>'
        return wrapped(("div", "section", "aside"), SIDE + ("more", "latest", "teasers", "recent-posts"), f"<h2>{bad}{words(1, 3, 0.7)}</h2>" + "".join(one() for _ in range(int(rng.integers(2, 5)))))

    def plain(layout: int) -> str:
        """A page of bare divs or of a layout table: nothing but words, links and order say what is what."""
        row = lambda inner, more="": f"<tr><td{more}>{inner}</td></tr>" if layout else f"<div>{inner}</div>"
        menu_cell = pick([" | ".join(link() for _ in range(int(rng.integers(3, 8)))), "<br>".join(link() for _ in range(int(rng.integers(3, 8)))), listing()])
        foot = pick([f"{bad}&copy; 20{int(rng.integers(10, 25))} {word().capitalize()} {words(0, 4, 0.7)}", f"{bad}Copyright {words(1, 4)}. All rights reserved.", f"{furniture_text()} {link()} {link()}", f"{bad}{words(1, 4, 0.8)} · {words(1, 3, 0.8)}"])
        parts = [row(f"<h2>{bad}{words(1, 3)}</h2>" if flip(0.4) else f"{bad}{words(1, 4)}") if flip(0.5) else "", row(menu_cell) if flip(0.85) else ""]
        parts += [f"<tr><td>{menu_cell}</td><td>{inner}</td>" + pick(["", f"<td>{furniture_text()}</td>", f"<td>{listing()}</td>"]) + "</tr>" if layout and flip(0.5) else row(inner)]
        parts += [row(talk()) if flip(0.4) else "", row(foot) if flip(0.85) else ""]
        return f"<table{pick(['', ' width=100%', ' border=0'])}>{''.join(parts)}</table>" if layout else "".join(parts)

    def part() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{good}{prose()}" + pick(["</p>", "</p>", "</p>", ""])
        if kind < 0.70:
            return f"<h{pick('2234')}>{good}{words(1, 8).capitalize()}" + "</h2>"
        if kind < 0.78:
            return "<ul>" + "".join(f"<li>{good}{sentence()}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if kind < 0.82:
            return f"<blockquote><p>{good}{prose()}</p></blockquote>"
        if kind < 0.85:
            return "<table>" + "".join(f"<tr><td>{good}{words(1, 4)}</td><td>{good}{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.88:
            return f"<pre>{good}{words(3, 12)}</pre>"
        if kind < 0.91:
            return f"<figure><img src='x'><figcaption>{good}{sentence()}</figcaption></figure>"
        if kind < 0.94:
            return advert()
        if kind < 0.96:
            return f"<p><b>{good}{sentence()}<br>"
        return f"<p>{good}{word().capitalize()}.</p>"

    title = words(2, 9).capitalize()
    inner = (f"<h1>{good}{title}</h1>" if flip(0.85) else "") + "".join(part() for _ in range(int(rng.choice([1, 3, 5, 8, 14]))))
    layout = rng.random()
    if layout < 0.45:
        body = f"<article{attr(BODY) if flip(0.4) else ''}>{inner}</article>"
    elif layout < 0.57:
        body = f"<main><article>{inner}</article></main>"
    elif layout < 0.7:
        body = f"<main{attr(BODY)}>{inner}</main>"
    else:
        body = f'<div {pick(["class", "id"])}="{pick(BODY)}">{inner}</div>'
    if layout > 0.82:
        whole = plain(int(flip(0.5)))
        return f"<html><head><title>{title}</title></head><body>{whole}</body></html>"
    before = "".join(f() for f, p in ((notice, 0.2), (header, 0.4), (menu, 0.7), (form, 0.15), (advert, 0.5), (side, 0.15)) if flip(p))
    after = "".join(f() for f, p in ((advert, 0.2), (talk, 0.4), (side, 0.3), (teasers, 0.12), (form, 0.15), (notice, 0.2), (footer, 0.85)) if flip(p))
    whole = f"{before}{body}{after}"
    if flip(0.3):
        whole = f'<div class="{pick(("page", "wrapper", "container", "site"))}">{whole}</div>'
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{whole}" + pick(["</body></html>", "</body></html>", ""])


#: Invented pages to train on, passes over them, and pages in a step.
TRAIN_PAGES, EPOCHS, BATCH = 1100, 9, 30


@functools.lru_cache(maxsize=1)
def trained(seed: int = 11) -> Labeller:
    """The labeller, trained with Adam on invented pages; the same seed gives the same weights."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(TRAIN_PAGES):
        blocks = [b for b in blocks_of(invent_page(rng)) if b.text.strip("\ue000\ue001 ")]
        y = np.array([b.text.count("\ue000") > b.text.count("\ue001") for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "")
        if blocks:
            data.append((features(blocks), y))
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    data.sort(key=lambda d: len(d[1]))
    cuts = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    for epoch in range(EPOCHS):
        rate = 0.01 * (0.7**epoch)
        for k in rng.permutation(len(cuts)):
            x, mask = _padded([d[0] for d in cuts[k]])
            y = np.zeros(mask.shape, np.float32)
            for i, d in enumerate(cuts[k]):
                y[i, : len(d[1])] = d[1]
            _, grad = model.gradients(x, mask, y)
            step += 1
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] = (model.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", extra: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the ``extra`` columns, text and n_blocks (blocks kept)."""
    spark = pages.sparkSession
    tune(spark)
    model = spark.sparkContext.broadcast(trained().p)
    kinds = dict(pages.dtypes)
    names = [id_col, *extra]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string, n_blocks long"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = model.value
        for b in batches:
            blocks = [blocks_of(p) for p in b.column(len(names)).to_pylist()]
            kept = [[x.text for x, p in zip(bs, ps) if p >= 0.5] for bs, ps in zip(blocks, labeller.label(blocks))]
            yield pa.record_batch([*b.columns[: len(names)], pa.array(["\n".join(k) for k in kept], pa.string()), pa.array(list(map(len, kept)), pa.int64())], names=[*names, "text", "n_blocks"])

    return pages.select(*names, html_col).mapInArrow(label, schema)
