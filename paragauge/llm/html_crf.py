"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into blocks of text at block-level tags. Each block has features from its ancestors
(tags, and the words of their class, id and role) and from its text. A chain model gives every block
the label main or not; the best labelling of a page is found by Viterbi, and the main blocks are
joined by line feeds. The model is trained on labelled pages; ``labelled_pages`` makes them by rule
from many layouts, bare pages and plain texts among them, with invented words. The weights of
ancestors are summed along the open elements, so deep nesting costs no more than its tags.

Defined cases: a null or empty page, and one without main blocks, gives the empty text; pages cut
off inside a tag or comment end there; blocks are taken whole, whatever their length; of labellings
that score the same the one that leaves a block out is taken at the end of a page; repeated rows give
the same text; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is not markup and never text of the page; without an end they go on to the
#: end of the page.
RAW = "script|style|textarea|title"
#: Elements whose content is never text of the page, where they have an end.
DROPPED = set("noscript template svg iframe object select button".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<({RAW})(?=[\s/>])[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*\Z",
    re.I | re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt"
    " rp s samp small span strike strong sub sup time tt u var wbr picture source input"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover"
    " mmultiscripts mprescripts mtable mtr mtd mlabeledtr mstyle mpadded mphantom menclose mfenced"
    " merror maction semantics annotation annotation-xml".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same kind.
SIBLINGS = set("li td th tr dt dd p option".split())
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "tr": {"table"}}
STRUCTURE = set(
    "article main section nav header footer aside form ul ol dl table figure figcaption div p"
    " h1 h2 h3 h4 h5 h6 blockquote pre li td body fieldset details address".split()
)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    leaf: str  # tag of the innermost element
    path: frozenset[str] | float  # features from the ancestors, or the sum of their weights


class Path:
    """Open elements, with the features they give to the blocks inside them.

    Each element adds its features once, when it opens, and takes them back when it ends, so a page
    costs the same however deep its elements are nested. With ``weight`` only the sum of the weights is
    kept, without it the features themselves.
    """

    def __init__(self, weight=None):
        self.stack: list[tuple[str, list[str]]] = []
        self.open: dict[str, list[int]] = {}  # per tag its places in the stack
        self.counts: dict[str, int] = {}
        self.weight, self.sum = weight, 0.0

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a kind, -1 if there is none."""
        places = self.open.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        own = ["name:" + w for w in names]
        if tag in STRUCTURE:
            own.append("in:" + tag)
        for f in own:
            self.counts[f] = self.counts.get(f, 0) + 1
            if self.counts[f] == 1 and self.weight:
                self.sum += self.weight(f, 0.0)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, own))

    def cut(self, place: int) -> None:
        """End all elements from a place of the stack on."""
        while len(self.stack) > place:
            tag, own = self.stack.pop()
            self.open[tag].pop()
            for f in own:
                self.counts[f] -= 1
                if not self.counts[f]:
                    del self.counts[f]
                    if self.weight:
                        self.sum -= self.weight(f, 0.0)

    def state(self) -> frozenset[str] | float:
        outside = "in:article" not in self.counts and "in:main" not in self.counts
        if self.weight:
            return self.sum + (self.weight("outside", 0.0) if outside else 0.0)
        return frozenset(self.counts) | ({"outside"} if outside else set())


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for groups in NAMES.findall(attributes):
        found += [w.lower() for w in WORDS.findall("".join(groups))]
    return tuple(found)


def _dropped(tokens: list[re.Match]) -> dict[int, int]:
    """Where dropped elements begin, and where the end tag of each ends; a self-closed svg is empty."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for token in tokens:
        tag = (token[3] or token[6] or "").lower()
        if tag not in DROPPED:
            continue
        if not (token[2] or token[5]):
            if tag != "svg" or not token[0].endswith("/>"):
                begun.setdefault(tag, []).append(token.start())
        elif begun.get(tag):
            out[begun[tag].pop()] = token.end()
    return out


def blocks(page: str, weight=None) -> list[Block]:
    """Leaf blocks in page order, without empty ones. ``weight`` gives the weight of a feature, with 0 for
    unknown ones; without it blocks hold the names of their features."""
    out: list[Block] = []
    path = Path(weight)
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            plain = " ".join(html.unescape("".join(text)).split())
            if plain:
                leaf = path.stack[-1][0] if path.stack else "none"
                out.append(Block(plain, min(linked, len(plain)), leaf, path.state()))
            text.clear()
        linked = 0

    at = 0
    tokens = list(TOKEN.finditer(page))
    dropped = _dropped(tokens)
    for token in tokens:
        if token.start() < at:  # inside a dropped element
            continue
        if token.start() > at:
            piece = page[at : token.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = dropped.get(token.start(), token.end())
        tag = token[3] or token[6]
        if not tag or at > token.end() or tag.lower() in DROPPED:
            continue
        tag, closing = tag.lower(), bool(token[2] or token[5])
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if closing:
            links = 0
            if path.last(tag) >= 0:
                path.cut(path.last(tag))
            continue
        if path.stack and path.stack[-1][0] == "p":
            path.cut(len(path.stack) - 1)
        if tag in SIBLINGS and path.last(tag) > max([path.last(t) for t in LISTS.get(tag, ())], default=-1):
            path.cut(path.last(tag))
        if tag not in VOID:
            path.push(tag, _names(token[4] or token[7] or ""))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def text_features(found: list[Block]) -> list[list[str]]:
    """Names of the features that each block has from its text, its place and its neighbours."""
    out = []
    n = len(found)
    lengths = [b.text.count(" ") + 1 for b in found]
    shares = [b.linked / max(len(b.text), 1) for b in found]
    whole = sum(lengths)
    for i, b in enumerate(found):
        own = ["bias", "leaf:" + b.leaf]
        own.append("words:" + str(sum(lengths[i] > w for w in (2, 5, 10, 20, 50))))
        own.append("links:" + str(sum(shares[i] > s for s in (0, 0.3, 0.7))))
        if b.text[-1] in ".!?…。":
            own.append("sentence")
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("rights")
        own.append("place:" + str(min(4 * i // n, 3)))
        for side, j in (("before:", i - 1), ("after:", i + 1)):
            if 0 <= j < n:
                kind = "links" if shares[j] > 0.5 else "long" if lengths[j] > 15 else "short"
                own.append(side + kind + (":" + found[j].leaf if found[j].leaf == b.leaf else ""))
            else:
                own.append(side + "none")
        own.append("part:" + str(sum(lengths[i] > share * whole for share in (0.02, 0.1, 0.3, 0.6))))
        out.append(own)
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of all features of each block."""
    return [sorted({*own, *b.path}) for own, b in zip(text_features(found), found)]


@dataclass
class Model:
    """Weights for the label main against not main, and of neighbouring labels."""

    weights: dict[str, float]
    start: np.ndarray  # by label
    moves: np.ndarray  # from, to

    def decode(self, found: list[Block]) -> list[bool]:
        """The best labelling: Viterbi over two labels."""
        if not found:
            return []
        weight = self.weights.get
        if isinstance(found[0].path, float):
            emit = [b.path + sum([weight(f, 0.0) for f in own]) for own, b in zip(text_features(found), found)]
        else:
            emit = [sum([weight(f, 0.0) for f in own]) for own in features(found)]
        (m00, m01), (m10, m11) = self.moves.tolist()
        out, main = float(self.start[0]), float(self.start[1]) + emit[0]
        back = []
        for e in emit[1:]:
            to_out = (out + m00, main + m10)
            to_main = (out + m01, main + m11)
            back.append((to_out[1] > to_out[0], to_main[1] >= to_main[0]))
            out, main = max(to_out), max(to_main) + e
        label = main > out
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, ridge: float = 1e-3) -> Model:
    """Conditional likelihood of the labels, climbed by gradient steps with running scales."""
    names = sorted({f for found, _ in pages for own in features(found) for f in own})
    number = {f: i for i, f in enumerate(names)}
    n, width = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((n, width, len(names)), np.float32)
    y = np.zeros((n, width), np.int64)
    real = np.zeros((n, width), bool)
    for i, (found, truth) in enumerate(pages):
        for j, own in enumerate(features(found)):
            x[i, j, [number[f] for f in own]] = 1
        y[i, : len(truth)] = truth
        real[i, : len(truth)] = True
    flat = x.reshape(-1, len(names))
    pair = real[:, 1:] & real[:, :-1]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    seen_start = np.bincount(y[:, 0], minlength=2)

    theta = np.zeros(len(names) + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, start, moves = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, width, 2))
        emit[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, width)
        ahead = np.empty((n, width, 2))
        ahead[:, 0] = start + emit[:, 0]
        for j in range(1, width):
            step_in = np.logaddexp(ahead[:, j - 1, :1] + moves[0], ahead[:, j - 1, 1:] + moves[1])
            ahead[:, j] = np.where(real[:, j, None], step_in + emit[:, j], ahead[:, j - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((n, width, 2))
        want_moves = np.zeros((2, 2))
        for j in range(width - 1, 0, -1):
            onward = emit[:, j] + behind[:, j]
            step_out = np.logaddexp(moves[:, 0] + onward[:, :1], moves[:, 1] + onward[:, 1:])
            behind[:, j - 1] = np.where(real[:, j, None], step_out, behind[:, j])
            joint = ahead[:, j - 1, :, None] + moves + onward[:, None, :] - total[:, None, None]
            want_moves += np.exp(joint[real[:, j]]).sum(0)
        chance = np.exp(ahead + behind - total[:, None, None])
        off = (y - chance[:, :, 1]) * real
        slope = np.concatenate([
            flat.T @ off.reshape(-1).astype(np.float32),
            seen_start - chance[:, 0].sum(0),
            (seen_moves - want_moves).reshape(-1),
        ]) / n - ridge * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta += 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return Model(
        dict(zip(names, theta[:-6].tolist())), theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy()
    )


MARK = "\ue000"  # a private-use character


def labelled_pages(n: int = 480, seed: int = 1) -> Iterator[str]:
    """Pages of many layouts; the text of main blocks has MARK in it."""
    some = random.Random(seed)
    pick = some.choice

    def word() -> str:
        return "".join(pick("tan ro mi el or su ka ne di vo".split()) for _ in range(some.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(some.randint(low, high)))

    def sentences() -> str:
        kind = some.random()
        if kind < 0.12:
            return words(1, 4)
        if kind < 0.2:
            return words(1, 5).capitalize() + pick([".", ":", "!"])
        if kind < 0.28:
            return " ".join(w + pick(["***", "&amp;&amp;", " |", "$$", "!!"]) for w in words(5, 40).split())
        return " ".join(words(3, 18).capitalize() + "." for _ in range(some.randint(1, 7)))

    def menu(least: int = 2) -> str:
        wrap = pick(["li", "li", "div"])
        items = "".join(
            f"<{wrap}><a href='/{word()}'>{words(1, 3)}</a></{wrap}>"
            for _ in range(some.randint(least, 8))
        )
        return f"<ul>{items}</ul>" if wrap == "li" else items

    def names(*options: str) -> str:
        value = pick(options)
        if some.random() < 0.3:
            value += " " + word()
        return f'{pick(["class", "class", "id"])}="{value}"'

    def plain() -> str:
        """Something beside the article that reads like sentences."""
        return "".join(f"<p>{sentences()}</p>" for _ in range(some.randint(1, 3))) if some.random() < 0.6 else sentences()

    def advert() -> str:
        own = names("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot")
        return f"<{(t := pick(['div', 'div', 'section', 'aside']))} {own}>{plain()}</{t}>"

    def notice() -> str:
        own = names("notice", "cookie-notice", "cookie-banner", "consent", "alert", "popup", "modal", "gdpr")
        return f"<div {own}>{plain()}</div>"

    def form() -> str:
        own = names("search", "login", "newsletter", "subscribe", "contact", "signup")
        inner = f"<label>{words(1, 4)}</label><input name=q><p>{sentences()}</p>"
        return pick([f"<form>{inner}</form>", f"<form {own}>{inner}</form>", f"<div {own}><form>{inner}</form></div>"])

    def comments() -> str:
        own = names("comments", "comment-list", "comment", "respond", "replies", "disqus", "reader-comments", "discussion")
        one = lambda: pick([f"<li>{sentences()}</li>", f"<p>{sentences()}</p>", f'<div class="comment"><b>{word()}</b><p>{sentences()}</p></div>', f"<article class='comment'><p>{sentences()}</p></article>"])
        inner = pick(["", f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 3)}</h3>"]) + "".join(one() for _ in range(some.randint(1, 6)))
        return f"<{(t := pick(['div', 'section', 'ol', 'ul']))} {own}>{inner}</{t}>"

    def related() -> str:
        own = names("related", "share", "social", "recommended", "more", "tags", "breadcrumb", "breadcrumbs", "pagination", "widget")
        return f"<div {own}>{pick(['', f'<h3>{words(1, 3)}</h3>'])}{menu(1)}</div>"

    def side() -> str:
        inner = pick([menu, plain, lambda: f"<h3>{words(1, 3)}</h3>" + plain(), lambda: menu() + plain()])()
        own = names("sidebar", "side", "rail", "secondary", "widget-area")
        return pick([f"<aside>{inner}</aside>", f"<aside {own}>{inner}</aside>", f"<div {own}>{inner}</div>"])

    def top() -> str:
        nav = pick([f"<nav>{menu()}</nav>", f"<nav {names('nav', 'menu', 'navbar')}>{menu()}</nav>", f"<div {names('nav', 'menu', 'navigation', 'topbar', 'navbar')}>{menu()}</div>"])
        logo = pick(["", f"<div {names('logo', 'brand', 'site-title', 'tagline')}>{words(1, 5)}</div>", f"<p>{sentences()}</p>"])
        return pick([nav, f"<header>{logo}{nav}</header>", f"<div {names('header', 'site-header', 'masthead', 'top')}>{logo}{nav}</div>", nav + advert(), f"<header>{logo}</header>{nav}"])

    def bottom() -> str:
        inner = pick([f"&copy; {word()} &middot; {sentences()}", f"<p>{sentences()}</p>{menu(1)}", f"<p>Copyright {word()}</p>", sentences()])
        return pick([f"<footer>{inner}</footer>", f"<div {names('footer', 'site-footer', 'bottom', 'copyright', 'legal')}>{inner}</div>", f"<footer {names('footer')}>{inner}</footer>"])

    def main_part() -> str:
        text = MARK + sentences()
        sloppy = f"<p><b>{text}<br>"
        return pick([f"<p>{text}</p>"] * 12 + [
            sloppy, sloppy, f"<h2>{MARK}{words(1, 6)}</h2>", f"<h3>{MARK}{words(1, 6)}</h3>", f"<div>{text}</div>",
            f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{text}</li><li>{MARK}{words(1, 9)}</li></ul>",
            f"<p>{text} <a href=x>{words(1, 4)}</a> {words(2, 6)}.</p>", f"<pre>{text}</pre>", f"<p>{text}",
        ])

    def article() -> str:
        head = f"<h1>{MARK}{words(2, 12)}</h1>"
        parts = [pick([head, head, f"<header>{head}</header>", ""])]
        for _ in range(some.randint(1, 14)):
            parts.append(main_part())
            if some.random() < 0.14:
                parts.append(pick([advert, related, side, notice, form])())
        if some.random() < 0.15:
            parts.append(pick([comments, related, form])())
        body = "".join(parts)
        body += "</b>" if some.random() < 0.2 else ""
        own = names("content", "post", "article", "entry", "entry-content", "story", "text", "main-content", "article-body")
        body = pick([f"<article>{body}</article>"] * 3 + [
            f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div {own}>{body}</div>", f"<div {own}>{body}</div>",
            f"<article {own}>{body}</article>", f"<section {own}>{body}</section>", f"<div {names('main', 'page', 'wrapper')}><div {own}>{body}</div></div>", body,
            f"<div>{body}</div>", f"<table><tr><td>{body}</td></tr></table>",
        ])
        return body

    def bare() -> str:
        """A page without names, and almost without elements that tell what they hold."""
        if some.random() < 0.2:
            return "\n\n".join([MARK + words(3, 18).capitalize() + "." + sentences()] + [words(3, 18).capitalize() + "." for _ in range(some.randint(0, 8))])
        long = lambda: MARK + " ".join(words(4, 18).capitalize() + "." for _ in range(some.randint(2, 7)))
        links = " | ".join(f"<a href={word()}>{words(1, 2)}</a>" for _ in range(some.randint(1, 6)))
        wrap = pick(["div", "div", "td", "p", "center", "section"])
        parts = [pick([long, long, lambda: long() + "<br><br>" + words(6, 20) + ".", lambda: MARK + words(1, 4).capitalize() + ".", lambda: f"<b>{long()}</b>"])() for _ in range(some.randint(1, 7))]
        parts[some.randrange(len(parts))] = long()
        body = "".join(f"<{wrap}>{x}</{wrap}>" for x in parts)
        if some.random() < 0.4:
            body = f"<{(h := pick(['h1', 'h2', 'h3']))}>{MARK}{words(1, 7)}</{h}>" + body
        if wrap == "td":
            body = f"<table><tr>{body}</tr></table>"
        first = pick(["", f"<div>{links}</div>", f"<div id=top>{links}</div>", f"<div><a href=/>{words(1, 3)}</a></div>", f"<p>{links}</p>"])
        last = pick(["", f"<div>Copyright {some.randint(1999, 2030)} {words(1, 4)}</div>", f"<p>&copy; {words(1, 3)}. {words(2, 6)}.</p>", f"<div>{links}</div>", f"<center>{links}<br>&copy; {word()}</center>"])
        return first + pick([body, f"<div>{body}</div>"]) + last

    for _ in range(n):
        if some.random() < 0.2:
            yield pick(["", "<html><body>", f"<html><head><title>{words(1, 5)}</title></head><body>"]) + bare()
            continue
        before = [top()] + [f() for f in (advert, notice, form, side, related) if some.random() < 0.25]
        after = [f() for f in (comments, related, side, advert, form, notice) if some.random() < 0.25]
        if some.random() < 0.9:
            after.append(bottom())
        page = "".join(before) + article() + "".join(after)
        if some.random() < 0.3:
            page = f"<div {names('page', 'wrapper', 'container', 'site')}>{page}</div>"
        yield (
            f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style><script>var t='</p>';"
            f"</script></head><body><!-- {word()} -->{page}" + pick(["</body></html>", ""])
        )


@lru_cache(maxsize=2)
def default_model(n: int = 480, seed: int = 1) -> Model:
    pages = []
    for page in labelled_pages(n, seed):
        found = blocks(page)
        truth = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "") or "."
        pages.append((found, truth))
    return train(pages)


def main_text(page: str, model: Model) -> str:
    found = blocks(page, model.weights.get)
    return "\n".join(b.text for b, main in zip(found, model.decode(found)) if main)


def extract(pages: DataFrame, keep: list[str], model: Model | None = None, column: str = "html") -> DataFrame:
    """``keep`` and text, n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.arrow_udf(T.StringType())
    def text(html_column: pa.Array) -> pa.Array:
        return pa.array([main_text(p, shared.value) if p else "" for p in html_column.to_pylist()], pa.string())

    return pages.select(*[F.col(f"`{c}`") for c in keep], text(F.col(f"`{column}`")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
