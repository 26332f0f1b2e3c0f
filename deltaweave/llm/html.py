"""Main text of web pages by a tree-structured graphical model.

Each element of a page's tree is content or not. Potentials connect an element with its parent (one table
per role of the child's tag) and with what is seen of it: hints in its class and id, length, links and
sentence ends of its text, paragraphs among its children, and how it lies to an article or main element, if the
page has one. Sum-product messages go from the leaves up and from the root down, and give each
element's exact marginal probability of being content; text of elements with a marginal of one half or more is
kept. All tables are counts over labelled pages; ``labelled_pages`` makes such pages from a seed, in many
layouts, and ``train`` takes any others of the same form.

One pass over the pages without a shuffle. Trees are arrays with parents before children, so depth is no
recursion. The parser never reads a place of the page more than a few times, however broken the markup: a tag's end
is looked for once, end tags without a start are known by a count, and each element is closed once.

Nulls: a null page is empty and has an empty text, as has a page without content. Repeated rows are read
alike. No pages: no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaweave.llm.text import slices

#: Elements without an end tag, elements whose text is no markup, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: An open element of the key is closed by a start tag among the values.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
CLOSERS = frozenset().union(*CLOSED_BY.values())
#: Elements past which a start tag closes nothing.
WALLS = frozenset("ul ol table article section div body html main aside nav tr td th dl form select head".split())
#: Elements that never hold main text, whatever is in them.
NEVER = RAW | frozenset("noscript template button select option datalist object svg canvas head".split())

#: Roles of tags.
ROLES = {
    "machine": "script style noscript template iframe object svg canvas head title meta link textarea select button input label fieldset",
    "menu": "nav menu",
    "banner": "header",
    "foot": "footer",
    "side": "aside dialog",
    "form": "form",
    "story": "article main",
    "heading": "h1 h2 h3 h4 h5 h6",
    "block": "p blockquote pre figure figcaption table tbody thead tr td th dl dt dd",
    "list": "ul ol li",
    "link": "a",
    "inline": "b i em strong span small u s sub sup code mark q cite abbr time font br img",
    "box": "div section center details",
    "root": "html body",
}
ROLE = {t: r for r, tags in ROLES.items() for t in tags.split()}
ROLE_NAMES = [*ROLES, "other"]

#: Words of classes and ids that tell boxes apart.
BAD = frozenset("ad ads advert advertisement banner sponsor sponsored promo nav navbar menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead comment comments reply replies respond disqus cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social related recommended more tags pagination pager search form widget toolbar copyright legal disclaimer".split())
GOOD = frozenset("article content main post entry story text body prose page".split())

#: A start tag past its "<": a quote counts after "=" alone, and only if it is closed. Nothing is tried twice.
_START = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_START_OPEN = re.compile(r"([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A slash that closes the element at once, and does not end an attribute's value without quotes.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_HINT = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[.!?](?:\s|$)")


@dataclass
class Tree:
    """Parents come before children. ``events``: (element, text) in page order; an element of -1 ends a block."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    hint: list[int] = field(default_factory=lambda: [0])
    label: list[int] = field(default_factory=lambda: [-1])
    events: list[tuple[int, str]] = field(default_factory=list)


def _attributes(name: str, text: str, labels: bool) -> tuple[int, int]:
    """(hint, label) of an element: 1 a word that tells of clutter, or hidden; 2 one that tells of content; 3 both."""
    hint, label, hidden = 0, -1, False
    for a in _ATTR.finditer(text):
        key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if key == "data-y":
            if labels and value in ("0", "1"):
                label = int(value)
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif key in ("class", "id", "role"):
            words = set(_HINT.findall(value))
            hint |= bool(words & BAD) | 2 * bool(words & GOOD)
    return (1 if hidden else 0 if name in ("html", "body") else hint), label  # classes of the page say nothing of a box


def parse(page: str, labels: bool = True) -> Tree:
    """The tree of a page, however broken its markup. ``labels``: read ``data-y``, where it is 0 or 1."""
    t = Tree()
    open_, count = [0], {}
    near = [0]  # of each open element the place of the last one, itself included, that matters to a start tag
    at, begin, size = 0, 0, len(page)
    closes: dict[str, re.Pattern] = {}
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        mark = page[lt + 1 : lt + 2]
        start = end = None
        if mark == "/" and (name := _NAME.match(page, lt + 2)):
            stop = page.find(">", name.end()) + 1
            end = name[0].lower()
        elif page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4) + 3
            stop = size if stop == 2 else stop
        elif mark in ("!", "?"):
            stop = page.find(">", lt) + 1
        elif mark.isalpha() and mark.isascii():
            start = _START.match(page, lt + 1) or _START_OPEN.match(page, lt + 1)
            stop = start.end() if start else 0
        else:  # no markup
            at = lt + 1
            continue
        if not stop:  # nothing ends a tag from here on, so the rest is text but for a comment
            at = page.find("<!--", lt)
            if at < 0:
                break
            size = at
            break
        if lt > begin:
            t.events.append((open_[-1], entities.unescape(page[begin:lt])))
        at = begin = stop
        if end:
            if count.get(end):
                while True:
                    tag = t.tag[open_.pop()]
                    near.pop()
                    count[tag] -= 1
                    if tag == end:
                        break
            if end in BLOCKS:
                t.events.append((-1, ""))
        elif start:
            name, given = start[1].lower(), start[2]
            if name in CLOSERS:
                k = near[-1]
                while k > 0:
                    own = t.tag[open_[k]]
                    if name in CLOSED_BY.get(own, ()):
                        for x in open_[k:]:
                            count[t.tag[x]] -= 1
                        del open_[k:], near[k:]
                        if own not in ("td", "th"):  # past a cell its row may end too
                            break
                    elif own in WALLS:
                        break
                    k = near[k - 1]
            hint, label = _attributes(name, given, labels) if given else (0, -1)
            if name == "html" and len(t.tag) == 1:
                t.label[0], t.hint[0] = label, hint
                continue
            node, parent = len(t.tag), open_[-1]
            t.tag.append(name)
            t.parent.append(parent)
            t.hint.append(hint)
            t.label.append(label if label >= 0 else t.label[parent])
            if name in BLOCKS:
                t.events.append((-1, ""))
            elif name == "br":
                t.events.append((parent, " "))
            if name in RAW:
                close = closes.setdefault(name, re.compile(f"</{name}", re.I)).search(page, at)
                at = close.start() if close else size
                t.events.append((node, page[begin:at]))
                begin = at
            if name not in VOID and not _CLOSED.search(given):
                near.append(len(open_) if name in CLOSED_BY or name in WALLS else near[-1])
                open_.append(node)
                count[name] = count.get(name, 0) + 1
    if begin < size:
        t.events.append((open_[-1], entities.unescape(page[begin:size])))
    return t


def observe(t: Tree) -> np.ndarray:
    """What is seen of each element: hint, words, links, sentence ends, paragraphs among its children, its place to the
    page's articles (0 there is none, 1 in one, 2 around one, 3 beside), words of its own, and whether it is in a box, each as a small number."""
    n = len(t.tag)
    words, linked, ends = [0] * n, [0] * n, [0] * n
    for node, text in t.events:
        if node >= 0 and t.tag[node] not in NEVER:
            k = len(text.split())
            words[node] += k
            ends[node] += len(_ENDS.findall(text))
    inside = [tag == "a" for tag in t.tag]
    story = [tag in STORY for tag in t.tag]
    around, paragraphs = [False] * n, [0] * n
    for k in range(1, n):
        p = t.parent[k]
        inside[k] = inside[k] or inside[p]
        story[k] = story[k] or story[p]
        if inside[k]:
            linked[k] = words[k]
        if t.tag[k] == "p":
            paragraphs[p] += 1
    direct = np.searchsorted([0, 11], np.array(words), side="left")
    for k in range(n - 1, 0, -1):
        p = t.parent[k]
        words[p] += words[k]
        linked[p] += linked[k]
        ends[p] += ends[k]
        around[p] = around[p] or story[k] or around[k]
    w, a, e = np.array(words), np.array(linked), np.array(ends)
    share = a / np.maximum(w, 1)
    place = np.where(np.array(story), 1, np.where(np.array(around), 2, 3)) if any(story) else np.zeros(n, np.int64)
    columns = [np.array(t.hint), np.searchsorted([0, 3, 12, 50], w, side="left"), np.where(w == 0, 0, 1 + np.searchsorted([0.0, 0.4, 0.9], share, side="left")), np.searchsorted([0, 1, 4], e, side="left"), np.minimum(np.array(paragraphs), 2), place, direct, np.array([p >= 0 and t.tag[p] not in ROOT for p in t.parent], np.int64)]
    return np.stack(columns, axis=1)


#: The elements that a page's main text is marked with.
STORY = frozenset(ROLES["story"].split())
ROOT = frozenset(ROLES["root"].split())
SIZES = (4, 5, 5, 4, 3, 4, 3, 2)


@dataclass
class TreeModel:
    """``pair[role, parent, child]`` and ``seen[k][role, state, value]``, all probabilities."""

    pair: np.ndarray
    seen: list[np.ndarray]

    def marginals(self, t: Tree) -> np.ndarray:
        """Each element's probability of being content."""
        role = np.array([_ROLE_INDEX.get(x, len(ROLE_NAMES) - 1) for x in t.tag])
        values = observe(t)
        own = np.ones((len(role), 2))
        for k, table in enumerate(self.seen):
            own *= table[role, :, values[:, k]]
        own /= own.sum(axis=1, keepdims=True)
        pair = self.pair[role]
        n = len(role)
        up = own.tolist()
        sent = [(1.0, 1.0)] * n
        tables = pair.tolist()
        for k in range(n - 1, 0, -1):
            (a00, a01), (a10, a11) = tables[k]
            u0, u1 = up[k]
            m0, m1 = a00 * u0 + a01 * u1, a10 * u0 + a11 * u1
            total = m0 + m1
            m0, m1 = m0 / total, m1 / total
            sent[k] = (m0, m1)
            p = up[t.parent[k]]
            p0, p1 = p[0] * m0, p[1] * m1
            scale = 1 / (p0 + p1)
            p[0], p[1] = p0 * scale, p1 * scale
        belief = [(1.0, 0.0)] * n
        r0, r1 = up[0][0] * tables[0][0][0], up[0][1] * tables[0][0][1]
        belief[0] = (r0 / (r0 + r1), r1 / (r0 + r1))
        for k in range(1, n):
            b0, b1 = belief[t.parent[k]]
            m0, m1 = sent[k]
            d0, d1 = b0 / max(m0, 1e-300), b1 / max(m1, 1e-300)
            (a00, a01), (a10, a11) = tables[k]
            u0, u1 = up[k]
            x0, x1 = (d0 * a00 + d1 * a10) * u0, (d0 * a01 + d1 * a11) * u1
            total = x0 + x1
            belief[k] = (x0 / total, x1 / total)
        return np.array([b[1] for b in belief])

    def text(self, page: str | None) -> str:
        """The main text: white space within a block is one space, blocks are joined by a line end."""
        if not page:
            return ""
        t = parse(page, labels=False)
        keep = self.marginals(t) >= 0.5
        never = [False] * len(t.tag)
        for k, tag in enumerate(t.tag):
            never[k] = tag in NEVER or k > 0 and never[t.parent[k]]
        blocks, now = [], []
        for node, text in [*t.events, (-1, "")]:
            if node >= 0:
                if keep[node] and not never[node]:
                    now.append(text)
            elif now:
                joined = " ".join("".join(now).split())
                if joined:
                    blocks.append(joined)
                now = []
        return "\n".join(blocks)


_ROLE_INDEX = {t: ROLE_NAMES.index(r) for t, r in ROLE.items()}


def train(pages: list[str], smooth: float = 0.3) -> TreeModel:
    """Tables from pages whose elements carry ``data-y`` (1: content; those without have their parent's)."""
    roles = len(ROLE_NAMES)
    pair = np.full((roles, 2, 2), smooth)
    seen = [np.full((roles, 2, size), smooth) for size in SIZES]
    overall = [np.full((2, size), smooth) for size in SIZES]
    for page in pages:
        t = parse(page)
        values = observe(t)
        for k, tag in enumerate(t.tag):
            role, y = _ROLE_INDEX.get(tag, roles - 1), max(t.label[k], 0)
            pair[role, max(t.label[t.parent[k]], 0) if k else 0, y] += 1
            for f, table in enumerate(seen):
                table[role, y, values[k, f]] += 1
                overall[f][y, values[k, f]] += 1
    for f, table in enumerate(seen):  # roles seldom seen lean on all roles together
        table += 2 * (overall[f] / overall[f].sum(axis=1, keepdims=True))[None]
        table /= table.sum(axis=2, keepdims=True)
    return TreeModel(pair / pair.sum(axis=2, keepdims=True), seen)


def labelled_pages(n: int = 1000, seed: int = 3) -> list[str]:
    """Pages with ``data-y`` on elements, in random layouts."""
    r = random.Random(seed)
    syllables = [c + v + e for c in "bdfgklmnprst" for v in "aeiou" for e in ("", "n", "r", "s")]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        style = r.random()
        one = lambda: words(1 if style < 0.3 else 4, 14)
        out = [one().capitalize() + r.choice(".....!?") for _ in range(r.randint(low, high))]
        if style > 0.93:
            return " ".join(w + r.choice(("!!", "***", "&amp;&amp;")) for w in " ".join(out).split())
        return " ".join(out)

    def box(names: str, inner: str, y: int = 0, tags: str = "div div section aside") -> str:
        key = r.choice(("class", "class", "id"))
        extra = r.choice(("", "-box", " wide", "-1"))
        tag = r.choice(tags.split())
        mark = f' {key}="{r.choice(names.split())}{extra}"' if r.random() < 0.9 or tag == "div" else ""
        return f'<{tag}{mark} data-y="{y}">{inner}</{tag}>'

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(r.randint(low, high))) + "</ul>"

    def advert() -> str:
        inner = r.choice((sentences(1, 3), words(2, 20), f"<p>{sentences(1, 2)}</p>", f'<a href="/x">{words(2, 6)}</a>'))
        return box("ad ads advert sponsored promo", inner, tags="div div div aside")

    def comments() -> str:
        many = "".join(f'<div class="comment"><b>{word()}</b><p>{sentences(1, 4)}</p></div>' for _ in range(r.randint(1, 5)))
        return box("comments replies respond", f"<h3>{words(1, 3)}</h3>{many}", tags="div section section")

    def notice() -> str:
        return box("cookie notice consent newsletter popup alert", f"<p>{sentences(1, 3)}</p><button>{word()}</button>", tags="div div aside section")

    def form() -> str:
        return f'<form data-y="0"><label>{words(1, 3)}</label><input name="q"><button>{word()}</button></form>'

    def related() -> str:
        return box("related recommended share social tags", f"<h3>{words(1, 3)}</h3>{links(2, 6)}", tags="div section aside nav")

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.12:
            return f"<p><b>{sentences(1, 3)}<br>"
        if kind < 0.2:
            return f"<p>{words(1, 5)}</p>"
        if kind < 0.3:
            return f'<p>{sentences(1, 3)} <a href="/y">{words(1, 4)}</a> {sentences(1, 2)}</p>'
        if kind < 0.34:
            return "<ul>" + "".join(f"<li>{sentences(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.38:
            return f"<blockquote><p>{sentences(1, 3)}</p></blockquote>"
        if kind < 0.42:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.46:
            return f"<pre><code>{words(4, 30)}</code></pre>"
        if kind < 0.5:
            return f"<h2>{words(1, 7)}</h2>"
        return f"<p>{sentences(1, r.choice((2, 5, 30)))}</p>"

    def telling(names: str, chance: float) -> str:
        """A class of one to three of the words, for elements on which they mean little."""
        if r.random() >= chance:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{" ".join(r.choices(names.split(), k=r.randint(1, 3)))}"'

    any_word = "post entry story page single has-sidebar sidebar-right social-share no-comments comments-open with-header footer-fixed tag-news layout wide"
    pages = []
    for _ in range(n):
        title = words(1, 12)
        short = r.random() < 0.15
        parts = [f"<h1>{title if not short else word()}</h1>"] * (r.random() < 0.9) + ([f"<p>{r.choice((word(), words(1, 4), sentences(1, 1)))}</p>"] if short else [paragraph() for _ in range(r.choice((1, 2, 2, 4, 9)))])
        for extra, chance in ((advert, 0.2), (related, 0.15), (comments, 0.15), (notice, 0.08), (form, 0.05)):
            if r.random() < chance * (0.4 if short else 1):
                parts.insert(r.randint(1, len(parts)), extra())
        body = "".join(parts)
        kind = r.random()
        if kind < 0.38:
            story = f'<article data-y="1"{telling(any_word, 0.4)}>{body}</article>'
        elif kind < 0.48:
            story = f'<main data-y="1"{telling(any_word, 0.3)}>{body}</main>'
        elif kind < 0.56:
            story = f'<main data-y="0"{telling(any_word, 0.3)}><article data-y="1">{body}</article></main>'
        elif kind < 0.7:
            story = box("content article post entry story text main", body, 1, "div div section")
        elif kind < 0.86 and not short:
            story = f'<div data-y="1">{body}</div>'
        else:
            story = re.sub(r"<(h1|p|ul|pre|table|h2|blockquote)>", r'<\1 data-y="1">', body)
        if r.random() < 0.3:
            story = f'<div{r.choice(("", telling("wrapper container row page layout", 1)))} data-y="0">{story}</div>'
        before, after = [], []
        if r.random() < 0.8:
            before.append(r.choice((f'<nav data-y="0">{links(1, 9)}</nav>', f'<nav data-y="0">{links(1, 9)}</nav>', f'<div data-y="0">{links(2, 9)}</div>')))
        if r.random() < 0.4:
            before.append(f'<header data-y="0">{r.choice((links(2, 6), f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>"))}</header>')
        for extra, chance in ((advert, 0.5), (notice, 0.2), (form, 0.15), (related, 0.2), (comments, 0.3)):
            if r.random() < chance:
                (before if extra is advert and r.random() < 0.7 else after).append(extra())
        if r.random() < 0.3:
            (before if r.random() < 0.5 else after).append(f'<aside data-y="0"><h3>{words(1, 3)}</h3>{r.choice((links(2, 8), f"<p>{sentences(1, 4)}</p>"))}</aside>')
        r.shuffle(after)
        if r.random() < 0.9:
            line = f"&copy; {word()} &middot; {r.choice((sentences(1, 3), links(2, 5), words(1, 6)))}" if r.random() < 0.6 else r.choice((f"(c) {word()}", words(1, 4), f"<p>{words(2, 6)}</p>", f"<p>{sentences(1, 2)}</p>"))
            after.append(f'<footer data-y="0">{line}</footer>' if r.random() < 0.8 else box("footer copyright foot legal", line, 0, "div"))
        inside = "".join(before) + story + "".join(after)
        if r.random() < 0.05:
            inside = f'<form data-y="0" action="/page">{inside}</form>'
        if 0.7 <= kind < 0.86 and r.random() < 0.3:
            inside = story
        if kind >= 0.86:  # paragraphs without a box, or text without markup, in pages with little else
            alone = r.random()
            if alone < 0.2:
                pages.append(f'<html data-y="1">{sentences(1, 9) if alone < 0.1 else words(2, 30)}')
            elif alone < 0.4:
                pages.append(f'<html data-y="0">{story}')
            elif alone < 0.55:
                pages.append(f'<html data-y="0"><body data-y="1">{"<br>".join(sentences(1, 4) for _ in range(r.randint(1, 5)))}</body>')
            if alone < 0.55:
                continue
            if alone < 0.75:
                inside = story
        head = f'<head data-y="0"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        pages.append(f'<!DOCTYPE html><html data-y="0"{telling(any_word, 0.1)}>{head}<body data-y="0"{telling(any_word, 0.3)}>{inside}</body></html>')
    return pages


def extract(pages: DataFrame, model: TreeModel | None = None, *, html: str = "html") -> DataFrame:
    """The pages without their html, with ``text`` and ``n_chars``. An own column with one of these names is replaced."""
    model = model or train(labelled_pages())
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    own = "_html" + "_" * max((len(c) for c in kept), default=0)  # no column has this name
    picked = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html}`").alias(own))
    schema = picked.drop(own).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in slices(batch.column(len(kept))):
                part = batch.slice(first, end - first)
                texts = [model.text(x.as_py()) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return picked.mapInArrow(run, schema)
