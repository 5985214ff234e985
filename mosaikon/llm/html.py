"""Main text of web pages by a tree-structured graphical model.

Every block of a page's tree is a node that holds main text or doesn't (a block around the article does, as does the
body); inline elements, links among them, belong to the block they stand in.  What a node shows is its tag,
its class, id and role words, how much of its text is linked, how much prose it holds, and where it stands to an
article or main element.  Words that the training pages don't know say nothing.  Parent and
child share a potential of the pairs of their states, learned from labelled pages.  Sum-product messages, upward and
then downward, give the exact marginal of each node; text is main text if that of its block is over one half.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
#: Elements that are part of the block they stand in.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em font g i ins kbd label map mark math meter nobr object output picture progress q rp rt ruby s samp small span strike "
    "strong sub sup svg text time tspan tt u var video".split()
)
#: Elements whose text is never shown as text of the page: code, the head, and what a form control offers.
MUTE = frozenset("script style noscript template head title iframe select datalist textarea".split())
#: What an opening tag closes, if open, up to a border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "title"} | {"hr"}
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SPACE, _NAME, _STOP = re.compile(r"\s+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[.,;:!?\u3002\uff0c\u060c]")


class Node:
    __slots__ = ("tag", "names", "parent", "chars", "linked", "stops", "heads", "nested", "place", "prose")

    def __init__(self, tag: str, names: tuple, parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.chars = self.linked = self.stops = self.prose = 0
        self.heads, self.nested, self.place = tag in HEADS, False, ""


class Tree(HTMLParser):
    """nodes: blocks in page order, the root first.  runs: (node, text) in page order, None where a block begins or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.runs = [Node("#root", (), -1)], []
        self.open = [("#root", 0, False, False)]  # tag, node, in a link, never shown

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"button", "td", "th", "table", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "body":  # text may have come before
            self._close({"head"}, set())
        if tag in BLOCK:
            self.runs.append(None)
        _, node, linked, mute = self.open[-1]
        if tag == "br":
            self.runs.append((node, " "))
        if tag in VOID:
            return
        if tag not in INLINE:
            names = tuple(dict.fromkeys(w.lower() for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for w in _NAME.findall(v)))
            self.nodes.append(Node(tag, names, node))
            node = len(self.nodes) - 1
        self.open.append((tag, node, linked or tag == "a", mute or tag in MUTE))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in INLINE and tag != "a":  # <path/>, <use/>: nothing stays open
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.runs.append(None)
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                del self.open[k:]
                return
            if tag in INLINE and name not in INLINE and name != "p":
                return  # a stray end of an inline element doesn't close blocks

    def _close(self, tags: set, border: set) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name in tags:
                del self.open[k:]
                return
            if name in border:
                return

    def handle_data(self, data):
        _, at, linked, mute = self.open[-1]
        if mute:
            return
        self.runs.append((at, data))
        node, n = self.nodes[at], len(data.strip())
        node.chars += n
        if linked:
            node.linked += n
        else:
            node.stops += len(_STOP.findall(data))

    @classmethod
    def of(cls, html: str) -> Tree:
        tree = cls()
        tree.feed(html)
        tree.close()
        nodes = tree.nodes
        for node in reversed(nodes):
            if node.stops and node.chars - node.linked >= 60:
                node.prose += node.chars - node.linked
            if node.parent >= 0:
                up = nodes[node.parent]
                up.chars, up.linked, up.stops, up.prose, up.heads = up.chars + node.chars, up.linked + node.linked, up.stops, up.prose + node.prose, up.heads or node.heads
        # the article or main element that has most of the page's prose, readers' comments left aside: blocks that are
        # named so, and articles in an article
        inner, aside = [False] * len(nodes), [False] * len(nodes)
        prose = nodes[0].prose
        for k, node in enumerate(nodes[1:], 1):
            up = node.parent
            inner[k] = inner[up] or nodes[up].tag == "article"
            node.nested = inner[k] and node.tag == "article"
            aside[k] = aside[up] or node.nested or not COMMENT.isdisjoint(node.names)
            if aside[k] and not aside[up]:
                prose -= node.prose
        most = [n.tag in ("article", "main") and not a and 5 * n.prose >= 2 * prose for n, a in zip(nodes, aside, strict=True)]
        holds = [False] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            holds[nodes[k].parent] |= holds[k] or most[k]
        for k, node in enumerate(nodes):
            above = nodes[node.parent].place if k else ""
            node.place = "in" if above in ("in", "chosen") else "chosen" if most[k] and not holds[k] else "holds" if holds[k] else "out" if holds[0] else "none"
        return tree


def features(tree: Tree) -> list[list[str]]:
    """What speaks for a node or against it; for one without text, nothing."""
    found, prose = [], max(1, tree.nodes[0].prose)
    for node in tree.nodes:
        if not node.chars:
            found.append([])
            continue
        at, links = node.place, str(min(3, int(node.linked / node.chars * 4)))
        f = ["tag " + node.tag, f"{at} tag {node.tag}", f"{at} links {links}", f"{at} part {math.ceil(node.prose / prose * 4)}", f"{at} size {min(3, int(math.log10(node.chars + 1)))}"]
        if node.prose:
            f.append(f"{at} prose")
        if node.heads:
            f.append(f"{at} heads {node.tag}" if node.tag in ("header", "footer", "nav", "aside") else "heads")
        if node.nested:
            f.append(f"{at} nested")
        f += ["name " + w for w in node.names]
        found.append(f)
    return found


class Model:
    """Potentials of a block and its parent, from the block's features.

    Inside main text a block is main text with the odds of `main`.  Nothing inside what isn't main text is; how alike a
    block is to those found there is the odds of `above`, in which the blocks of one parent have one voice together.
    Both are (weights of features, bias).
    """

    def __init__(self, main: tuple[dict, float], above: tuple[dict, float]):
        self.main, self.above = main, above

    def potentials(self, tree: Tree) -> list[tuple[float, float, float]]:
        """For each node: of main in main, of other in main, of other in other (main in other has none)."""
        found, nodes = [], tree.nodes
        kin = [0] * len(nodes)
        for node in nodes:
            if node.chars and node.parent >= 0:
                kin[node.parent] += 1
        (w, b), (v, c) = self.main, self.above
        for node, fs in zip(nodes, features(tree), strict=True):
            if not fs or node.parent < 0:
                found.append((0.5, 0.5, 0.5))  # without text it says nothing
                continue
            x, y = b + sum([w.get(f, 0.0) for f in fs]), c + sum([v.get(f, 0.0) for f in fs])
            p = 1 / (1 + math.exp(-max(-12.0, min(12.0, x))))
            found.append((p, 1 - p, math.exp(-max(-12.0, min(12.0, y)) / kin[node.parent])))
        return found

    def marginals(self, tree: Tree) -> list[float]:
        """P(main text) of each node: messages to the parent first, back to the children then."""
        nodes, psi = tree.nodes, self.potentials(tree)
        b0, b1, up = [1.0] * len(nodes), [1.0] * len(nodes), [(1.0, 1.0)] * len(nodes)
        b0[0] = 0.0  # the page itself may hold main text
        for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
            p11, p10, p00 = psi[k]
            m0, m1 = p00 * b0[k], p10 * b0[k] + p11 * b1[k]
            s = m0 + m1
            up[k] = (m0 / s, m1 / s)
            par = nodes[k].parent
            b0[par], b1[par] = b0[par] * up[k][0], b1[par] * up[k][1]
            s = b0[par] + b1[par]
            b0[par], b1[par] = b0[par] / s, b1[par] / s
        out = [b1[0] / (b0[0] + b1[0])] * len(nodes)
        for k in range(1, len(nodes)):
            par, (p11, p10, p00) = nodes[k].parent, psi[k]
            q1, q0 = out[par] / max(up[k][1], 1e-300), (1 - out[par]) / max(up[k][0], 1e-300)
            x0, x1 = b0[k] * (p00 * q0 + p10 * q1), b1[k] * p11 * q1
            out[k] = x1 / (x0 + x1) if x0 + x1 else 0.0
        return out

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        tree = Tree.of(html)
        p, blocks, now = self.marginals(tree), [], []
        for run in [*tree.runs, None]:
            if run is None:
                text = _SPACE.sub(" ", "".join(now)).strip()
                if text:
                    blocks.append(text)
                now = []
            elif p[run[0]] > 0.5:
                now.append(run[1])
        return "\n\n".join(blocks)


#: Words in class, id and role that name what isn't main text, and what is; and words that say nothing.
NOISE = {
    "menu": "nav navbar navigation menu topmenu breadcrumb breadcrumbs pagination pager tabs toc", "head": "header masthead banner topbar branding logo",
    "foot": "footer bottom copyright legal colophon contentinfo", "side": "sidebar aside widget related recommended trending popular complementary teaser",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial adslot", "notice": "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup paywall",
    "social": "share social sharing follow buttons toolbar", "comment": "comment comments respond disqus discussion replies reply",
}
COMMENT = frozenset(NOISE["comment"].split())
MAIN = "content article post entry main body story prose copy maincontent".split()
NEUTRAL = "archive section block row col grid inner outer box panel item card wrap wrapper container page area view text more left right one two".split()


def labelled_pages(n: int = 700, seed: int = 5) -> list[str]:
    """Pages made by rule whose main text is known: elements marked data-main="0" hold none, and nothing inside does.

    Main text comes in paragraphs with and without links, linked headings, lists of linked references, tables, and in
    blocks of known, unknown and no names.
    """
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("th er on an re la de ei".split(), k=1 + k % 3)) for k in range(300)]
    pick = lambda *x: rng.choice(x)
    word = lambda: rng.choice(lexicon)
    words = lambda a, b: " ".join(rng.choices(lexicon, k=rng.randrange(a, b)))
    link = lambda a, b: f'<a href="/{word()}">{words(a, b)}</a>'
    links = lambda k: "".join(f"<li>{link(1, 3)}</li>" for _ in range(k))
    none = ' data-main="0"'

    def prose(a: int, b: int) -> str:
        return ". ".join(words(3, 14) + pick("", ", " + words(2, 9)) for _ in range(max(1, rng.randrange(a, b) // 10))) + "."

    def named(*known: str) -> str:
        kind = rng.random()
        name = pick(*(known or NEUTRAL)) if kind < 0.35 else pick(*NEUTRAL) if kind < 0.55 else word() + str(rng.randrange(0, 99)) if kind < 0.75 else ""
        return f' {pick("class", "class", "id")}="{name}"' if name else ""

    def part(kind: str, within: bool) -> str:
        own = {"menu": ("nav", "nav", "div", "ul"), "head": ("header", "header", "div"), "foot": ("footer", "footer", "div"), "side": ("aside", "aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "dialog"), "social": ("div", "ul"), "comment": ("section", "div", "ol")}[kind]
        tag = pick(*(x for x in own if not (within and x == "header")))
        plain = tag in ("nav", "header", "footer", "aside", "dialog") or (kind == "menu" and not within)
        name = f' {pick("class", "class", "id", "role")}="{pick(*NOISE[kind].split())}"'
        if plain and rng.random() < 0.6:
            name = named(*NOISE[kind].split())
        item = lambda: f"<{(t := pick('div', 'article', 'p'))}{pick('', '', ' class=comment')}>{words(1, 3)}: {pick(prose(5, 60), f'<p>{prose(5, 60)}</p>')}</{t}>"
        thread = lambda: f"<{(t := pick('div', 'article', 'article'))}{pick('', ' class=comment')}><p>{words(1, 3)}</p><p>{prose(60, 150)}</p></{t}>"
        inner = {
            "menu": lambda: links(rng.randrange(3, 9)) if tag == "ul" else f"<ul>{links(rng.randrange(3, 9))}</ul>", "head": lambda: pick(f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", f"{link(1, 3)}", f"<p>{words(1, 6)}</p>", f"<nav><ul>{links(4)}</ul></nav>"),
            "foot": lambda: pick(f"{pick('&copy; ', '')}{words(2, 8)}", f"<p>&copy; {prose(5, 40)}</p>", f"<ul>{links(4)}</ul>"), "side": lambda: f"<h3>{words(1, 4)}</h3>" + pick(f"<ul>{links(4)}</ul>", f"<p>{prose(5, 40)}</p>", f"<ul>{links(4)}</ul><p>{prose(3, 25)}</p>", f"<article><h4>{link(2, 5)}</h4><p>{words(4, 12)}</p></article>"),
            "ad": lambda: pick(words(3, 20), f"<p>{prose(3, 40)}</p>", f'<a href="/x">{words(2, 9)}</a>'), "notice": lambda: pick(f"<p>{prose(5, 35)}</p>", prose(5, 25) + " <button>OK</button>"),
            "social": lambda: links(3) if tag == "ul" else f'<span>{words(1, 4)}</span><a href="/s">{words(1, 2)}</a>', "comment": lambda: "".join(item() for _ in range(rng.randrange(1, 5))) if rng.random() < 0.7 else "".join(thread() for _ in range(rng.randrange(1, 9))),
        }[kind]()
        return f"<{tag}{name}{none}>{inner}</{tag}>"

    def form() -> str:
        return f'<form{none}><label>{words(1, 4)}</label><input name="q"><p>{words(1, 9)}</p><button>{words(1, 2)}</button></form>'

    def inline(text: str) -> str:
        for _ in range(rng.randrange(0, 4)):
            text = f"{words(1, 9)} {pick('<b>%s</b>', '<em>%s</em>', '<a href=/y>%s</a>', '<a href=/y>%s</a>', '<span class=q7>%s</span>', '<i>%s</i>', '<code>%s</code>', '<math>%s</math>') % words(1, 5)} {text}"
        return text

    def block() -> str:
        kind = rng.random()
        text = pick(lambda: words(1, 8), lambda: prose(5, 30), lambda: prose(20, 90), lambda: prose(60, 150))()
        if kind < 0.54:
            return f"<p>{inline(text)}</p>"
        if kind < 0.58:
            return f"<p>{pick('', words(1, 3) + ' ')}{link(2, 8)}{pick('', '.', ' ' + words(1, 3) + ' ' + link(1, 5) + '.')}</p>"
        if kind < 0.68:
            return f"<{(t := pick('h1', 'h2', 'h3', 'h4'))}>{pick(words(1, 9), link(1, 9))}</{t}>"
        if kind < 0.76:
            return f"<{(t := pick('ul', 'ol'))}>{''.join(f'<li>{pick(words(2, 20), link(2, 9), prose(9, 40))}</li>' for _ in range(4))}</{t}>"
        if kind < 0.8:  # linked references
            return f"<{(t := pick('ul', 'ol'))}>{''.join(f'<li>{link(2, 9)}</li>' for _ in range(rng.randrange(2, 7)))}</{t}>"
        if kind < 0.83:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.86:
            return f"<table><tr><th>{words(1, 3)}</th><td>{pick(words(1, 6), link(1, 3))}</td></tr></table>"
        if kind < 0.94:
            return f"<{(t := pick('div', 'div', 'pre', 'figcaption'))}{pick('', named())}>{inline(text)}</{t}>"
        if kind < 0.97:
            return f"<{(t := pick('section', 'div'))}{named()}><h3>{words(1, 5)}</h3><p>{inline(text)}</p><p>{words(3, 9)}</p></{t}>"
        return f"<div{named()}>{block()}</div>"

    pages = []
    for _ in range(n):
        few = rng.random() < 0.2
        title = f"<h1>{pick(words(2, 12), words(2, 12), link(2, 9))}</h1>"
        lead = pick(title, title, f"<header>{title}<p>{words(2, 6)}</p></header>", "")
        inside = [lead] + [block() for _ in range(rng.randrange(1, 4 if few else 14))]
        tag = pick("article", "article", "main", "div", "section", "div")
        if tag in ("div", "section"):  # nothing but its text tells it from what is around
            inside += [f"<p>{inline(prose(40, 120))}</p>" for _ in range(2)]
        if tag in ("article", "main") and rng.random() < 0.2:  # hardly any text
            inside = [pick(lead, ""), f"<p>{pick(words(1, 2), words(1, 4), prose(3, 12))}</p>"]
        for _ in range(rng.randrange(0, 3)):
            inside.insert(rng.randrange(1, len(inside) + 1), pick(part("ad", True), part("social", True), part("side", True), part("menu", True), form()))
        if rng.random() < 0.3:
            inside.append(part("comment", True))
        if tag == "article" and rng.random() < 0.1:  # comments that only their place tells
            inside += [f"<article{none}><p>{words(1, 3)}</p><p>{prose(5, 120)}</p></article>" for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.15:
            inside.append(part("foot", True))
        body = f"<{tag}{named(*MAIN)}>{''.join(inside)}</{tag}>"
        if rng.random() < 0.1:
            body = "".join(inside)  # right in the body
        if rng.random() < 0.4:
            body = f"<{(t := pick('div', 'main', 'section'))}{named(*MAIN)}>{pick('', part('side', False))}{body}{pick('', part('side', False))}</{t}>"
        bare = rng.random() < 0.15
        before = [] if bare else [part(k, False) for k in ("notice", "head", "menu", "ad", "side") if rng.random() < 0.5] + ([form()] if rng.random() < 0.2 else [])
        after = [] if bare else [part(k, False) for k in ("comment", "side", "ad", "social", "notice", "foot") if rng.random() < 0.45]
        head = f"<head><title>{words(2, 9)}</title><style>p{{}}</style><script>var x='</p>';</script></head>"
        pages.append(f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return pages


class _Marked(Tree):
    """A tree that notes which elements are marked as holding no main text."""

    def __init__(self):
        super().__init__()
        self.none = set()

    def handle_starttag(self, tag, attrs):
        before = len(self.nodes)
        super().handle_starttag(tag, attrs)
        if len(self.nodes) > before and ("data-main", "0") in attrs:
            self.none.add(before)

    def states(self) -> list[int]:
        """1 for main text."""
        found = []
        for k, node in enumerate(self.nodes):
            found.append(0 if k in self.none or (node.parent >= 0 and not found[node.parent]) else 1)
        return found


def _logistic(nodes: Counter, steps: int) -> tuple[dict, float]:
    """(features, state) -> how many, to weights and bias."""
    rows, y, n = [f for f, _ in nodes], np.array([s for _, s in nodes], float), np.array(list(nodes.values()), float)
    names = {f: k for k, f in enumerate(sorted({f for r in rows for f in r}))}
    sizes = np.array([len(r) for r in rows])
    ri, ci = np.repeat(np.arange(len(rows)), sizes), np.array([names[f] for r in rows for f in r])
    w, b, m = np.zeros(len(names)), 0.0, n.sum()
    step = 4 / (np.bincount(ci, ((sizes + 1) * n)[ri], len(names)) / m + 1e-3)
    for _ in range(steps):
        g = n * (1 / (1 + np.exp(-(b + np.bincount(ri, w[ci], len(rows))))) - y)
        w -= step * (np.bincount(ci, g[ri], len(names)) / m + 1e-5 * w)
        b -= 0.5 * g.sum() / m
    return {f: float(w[k]) for f, k in names.items()}, float(b)


def fit(pages: list[str] | None = None, steps: int = 400) -> Model:
    """Learn from pages in which data-main="0" marks what isn't main text (labelled_pages() by default)."""
    main, above = Counter(), Counter()
    for html in labelled_pages() if pages is None else pages:
        tree = _Marked.of(html)
        state = tree.states()
        for node, f, s in zip(tree.nodes, features(tree), state, strict=True):
            if f and node.parent >= 0:
                above[tuple(f), state[node.parent]] += 1
                if state[node.parent]:
                    main[tuple(f), s] += 1
    weights, bias = _logistic(above, steps)
    ones, n = sum(c for (_, s), c in above.items() if s), above.total()
    # how frequent each state is counts in the odds of the parents themselves
    return Model(_logistic(main, steps), (weights, bias - math.log((ones + 1) / (n - ones + 1))))


@functools.cache
def _own() -> Model:
    """The model of the pages made by rule, learned once in a process."""
    return fit()


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages -> pages with text (the main text) and n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by two \\n.  A
    null or empty html has the text "".  Columns of the input stay, but for those named text and n_chars, which are
    replaced.  Broken markup is read as far as it goes.  An empty table gives none.
    """
    small_batches(pages.sparkSession, 128)
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*own)
    model = model or _own()
    parts = (model.main, model.above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*parts)
        for b in batches:
            done = [m.extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())], [*own, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{kinds}, text string, n_chars long")
