"""Main text of web pages: a bidirectional LSTM labels the blocks of a page, in sequence, as main text or not.

A page is read once into leaf blocks: runs of text between the borders of block elements, with the path of open elements. Each block is a
vector: the sum of learned vectors of the path's words (element names, words of class, id and role), the mean of learned vectors of its hashed
words, and a few measures. Two LSTMs, one forward and one backward, read the page's blocks, and each block is judged by
both states, so with the whole page in view. Both are plain numpy.

Nobody labels the blocks of given pages, so the model learns from laid-out pages: texts of a bounded sample of the given pages (SAMPLE), dealt
anew into layouts whose parts are known (`Layouts`), with telling, misleading and no names of classes. What is learned so is how
places, lengths, links and neighbours tell main text, not the words of one site.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import bounded_batches, texts_of

#: Given pages whose texts are dealt into layouts, pages laid out, and rounds of training.
SAMPLE, PAGES, ROUNDS = 200, 1400, 5
#: Learned vectors: slots of path words and of text words, and their width; units of each LSTM.
PATH_SLOTS, WORD_SLOTS, WIDTH, UNITS = 1 << 11, 1 << 12, 16, 24
#: Blocks times pages that go through the LSTMs at once, unless one page has more.
TOGETHER = 1 << 14

# Elements that end a block, those whose text is never shown, those without an end, and those that hold plain characters.
BLOCK_TAGS = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p pre section select "
    "summary table tbody td template textarea tfoot th thead title tr ul").split())
HIDDEN = frozenset("script style title template noscript textarea iframe svg math canvas object select noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noframes xmp".split())
# An element that starts closes an open one of these, as its end may be left out; `p` ends at every other block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("table ul ol dl body html div section article td".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
MEASURES = 8


def slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % slots


class Page:
    """Leaf blocks of a page: `texts`, the place of each in the tree of open elements (`nodes`), and the share of its letters inside links.

    `parents` and `names` describe that tree: the place above, and the path words of the element. Element 0 is the page.
    """

    def __init__(self, html: str | None) -> None:
        self.texts: list[str] = []
        self.nodes: list[int] = []
        self.linked: list[float] = []
        self.parents, self.names, self.tags = [0], [[]], [""]
        self._read(html or "")

    def _read(self, html: str) -> None:
        stack, links, hidden = [0], 0, 0
        parts: list[str] = []
        in_links = 0
        tags = self.tags
        opened: dict[str, int] = {}

        def end_block() -> None:
            nonlocal in_links
            text = " ".join("".join(parts).split())
            if text:
                self.texts.append(text)
                self.nodes.append(stack[-1])
                self.linked.append(min(1.0, in_links / len(text)))
            parts.clear()
            in_links = 0

        def close(depth: int) -> None:
            nonlocal hidden
            while len(stack) > depth:
                tag = tags[stack.pop()]
                opened[tag] -= 1
                hidden -= tag in HIDDEN

        at = 0
        while True:
            found = _MARKUP.search(html, at)
            piece = html[at:found.start() if found else len(html)]
            if piece and not hidden:
                text = unescape(piece) if "&" in piece else piece
                parts.append(text)
                in_links += len(text) if links else 0
            if not found:
                break
            at = found.end()
            ends, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                links = 0 if ends else 1
            if tag in VOID:
                if tag == "hr":
                    end_block()
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag not in BLOCK_TAGS and tag not in HIDDEN:
                continue
            if ends:
                end_block()
                if opened.get(tag):
                    close(next(d for d in range(len(stack) - 1, 0, -1) if tags[stack[d]] == tag))
                    links = 0
                continue
            end_block()
            if tags[stack[-1]] == "p":
                close(len(stack) - 1)
            for other in CLOSES.get(tag, ()):
                depth = len(stack) - 1 if opened.get(other) else 0
                while depth and tags[stack[depth]] != other and tags[stack[depth]] not in _SCOPES:
                    depth -= 1
                if depth and tags[stack[depth]] == other:
                    close(depth)
            if rest.endswith("/") and tag not in RAW:
                continue
            names = [tag]
            for values in _NAMES.findall(rest):
                names += [w.lower() for w in _WORD.findall(next((v for v in values if v), ""))]
            self.parents.append(stack[-1])
            self.names.append(names)
            tags.append(tag)
            stack.append(len(tags) - 1)
            opened[tag] = opened.get(tag, 0) + 1
            hidden += tag in HIDDEN
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
                close(len(stack) - 1)
                at = end.end() if end else len(html)
        end_block()


class Features:
    """Vectors of blocks that the network reads: measures, word slots and path slots; slots are remembered while they are few."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.paths: dict[str, int] = {}

    def word_slots(self, text: str) -> list[int]:
        known, out = self.words, []
        for word in text.split():
            k = known.get(word)
            if k is None:
                if len(known) > 1 << 18:
                    known.clear()
                k = known[word] = slot(word.lower(), WORD_SLOTS)
            out.append(k)
        return out

    def path_slots(self, names: list[str]) -> list[int]:
        known = self.paths
        if len(known) > 1 << 16:
            known.clear()
        return [known[n] if n in known else known.setdefault(n, slot(n, PATH_SLOTS)) for n in names]

    @staticmethod
    def measures(page: Page) -> np.ndarray:
        n = len(page.texts)
        out = np.zeros((n, MEASURES))
        for i, text in enumerate(page.texts):
            length = len(text)
            out[i, :6] = (
                np.log1p(length) / 4, page.linked[i], min(text.count(" ") + 1, 60) / 60, text[-1] in ".!?…:;\"'”»",
                sum(text.count(c) for c in ".,;!?") / (text.count(" ") + 1), any(c in text for c in "|©»›"))
        out[:, 6], out[:, 7] = (np.arange(n) + 0.5) / max(n, 1), 1
        return out


class Network:
    """Embeddings, two LSTMs and a logistic layer over both states."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        inputs = 2 * WIDTH + MEASURES
        self.p = {"path": r.normal(0, 0.3, (PATH_SLOTS, WIDTH)), "word": r.normal(0, 0.3, (WORD_SLOTS, WIDTH)), "out": r.normal(0, 0.2, 2 * UNITS + inputs), "bias": np.zeros(1)}
        for side in ("f", "b"):
            self.p[f"w{side}"] = r.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * UNITS))
            self.p[f"u{side}"] = r.normal(0, 1 / np.sqrt(UNITS), (UNITS, 4 * UNITS))
            self.p[f"c{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], UNITS)  # gates: in, keep, out, new; `keep` starts open

    # Inputs

    def path_vectors(self, page: Page, features: Features) -> np.ndarray:
        """Each element's vector is that of the element around it plus its own names', so deep paths cost no more than flat ones."""
        out = np.zeros((len(page.parents), WIDTH))
        table = self.p["path"]
        for i in range(1, len(out)):
            out[i] = out[page.parents[i]] + table[features.path_slots(page.names[i])].sum(0)
        return out

    def inputs(self, page: Page, features: Features) -> np.ndarray:
        words = [features.word_slots(t) for t in page.texts]
        sizes = np.array([len(w) for w in words])
        flat = np.fromiter((k for w in words for k in w), np.int64, sizes.sum())
        means = np.add.reduceat(self.p["word"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return np.hstack([np.tanh(self.path_vectors(page, features)[page.nodes]), means, features.measures(page)])

    # One direction over (steps, pages, inputs); `live` marks steps inside a page.

    def _run(self, x: np.ndarray, live: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        u, gates = self.p[f"u{side}"], x @ self.p[f"w{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((n, UNITS)), np.zeros((n, UNITS))
        states, kept = np.zeros((steps, n, UNITS)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ u
            s = 1 / (1 + np.exp(-z[:, :3 * UNITS]))
            i, f, o, g = s[:, :UNITS], s[:, UNITS:2 * UNITS], s[:, 2 * UNITS:], np.tanh(z[:, 3 * UNITS:])
            new = f * c + i * g
            m = live[t][:, None]
            new = np.where(m, new, c)
            squashed = np.tanh(new)
            after = np.where(m, o * squashed, h)
            if keep:
                kept.append((t, i, f, o, g, c, squashed, h))
            h, c = after, new
            states[t] = h
        return states, kept

    def _logits(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        forward, kept_f = self._run(x, live, "f", keep)
        backward, kept_b = self._run(x, live, "b", keep)
        seen = np.concatenate([forward, backward, x], axis=2)
        return seen @ self.p["out"] + self.p["bias"], seen, kept_f, kept_b

    def judge(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page, given their inputs."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            steps = len(pages[order[-1]])
            some = order[-max(1, TOGETHER // steps):]
            # Pages of unlike length go apart, the longest first.
            some = [i for i in some if 2 * len(pages[i]) >= steps]
            del order[-len(some):]
            x, live = stacked([pages[i] for i in some])
            logits = self._logits(x, live)[0]
            for k, i in enumerate(some):
                out[i] = 1 / (1 + np.exp(-logits[:len(pages[i]), k]))
        return out

    # Training

    def gradients(self, pages: list[Page], labels: list[np.ndarray], features: Features) -> tuple[float, dict[str, np.ndarray]]:
        """Loss per block of a batch, and its gradient by every parameter."""
        x, live = stacked([self.inputs(p, features) for p in pages])
        y = stacked([np.asarray(v, float)[:, None] for v in labels])[0][:, :, 0]
        logits, seen, kept_f, kept_b = self._logits(x, live, keep=True)
        p = 1 / (1 + np.exp(-logits))
        total = live.sum()
        loss = -(live * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total
        d = live * (p - y) / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = np.tensordot(d, seen, ((0, 1), (0, 1))), np.array([d.sum()])
        d_seen = d[:, :, None] * self.p["out"]
        dx = d_seen[:, :, 2 * UNITS:].copy()
        for side, kept, d_states in (("f", kept_f, d_seen[:, :, :UNITS]), ("b", kept_b, d_seen[:, :, UNITS:2 * UNITS])):
            w, u = self.p[f"w{side}"], self.p[f"u{side}"]
            dh, dc = np.zeros((x.shape[1], UNITS)), np.zeros((x.shape[1], UNITS))
            for t, i, f, o, new, c, squashed, h in reversed(kept):
                m = live[t][:, None]
                dh = dh + d_states[t]
                out = np.where(m, dh, 0)
                dnew = np.where(m, dc + out * o * (1 - squashed ** 2), 0)
                dz = np.hstack([dnew * new * i * (1 - i), dnew * c * f * (1 - f), out * squashed * o * (1 - o), dnew * i * (1 - new ** 2)])
                g[f"u{side}"] += h.T @ dz
                g[f"w{side}"] += x[t].T @ dz
                g[f"c{side}"] += dz.sum(0)
                dx[t] += dz @ w.T
                dh = np.where(m, dz @ u.T, dh)
                dc = np.where(m, dnew * f, dc)
        for k, page in enumerate(pages):
            n = len(page.texts)
            d_path = dx[:n, k, :WIDTH] * (1 - x[:n, k, :WIDTH] ** 2)
            d_nodes = np.zeros((len(page.parents), WIDTH))
            np.add.at(d_nodes, page.nodes, d_path)
            for i in range(len(page.parents) - 1, 0, -1):
                np.add.at(g["path"], features.path_slots(page.names[i]), d_nodes[i])
                d_nodes[page.parents[i]] += d_nodes[i]
            words = [features.word_slots(t) for t in page.texts]
            sizes = np.array([len(s) for s in words])
            np.add.at(g["word"], [s for w in words for s in w], np.repeat(dx[:n, k, WIDTH:2 * WIDTH] / sizes[:, None], sizes, axis=0))
        return float(loss), g

    def train(self, pages: list[Page], labels: list[np.ndarray], rounds: int = ROUNDS, batch: int = 20, rate: float = 0.01) -> None:
        """Adam over batches of pages of like length."""
        features = Features()
        moved = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        order, r, t = np.argsort([len(p.texts) for p in pages], kind="stable"), np.random.default_rng(3), 0
        batches = [order[a:a + batch] for a in range(0, len(order), batch)]
        for turn in range(rounds):
            for b in r.permutation(len(batches)):
                t += 1
                _, g = self.gradients([pages[i] for i in batches[b]], [labels[i] for i in batches[b]], features)
                for k, v in self.p.items():
                    one, two = moved[k]
                    one += 0.1 * (g[k] - one)
                    two += 0.01 * (g[k] ** 2 - two)
                    v -= rate * (0.5 ** max(0, turn - 1)) * (one / (1 - 0.9 ** t)) / (np.sqrt(two / (1 - 0.99 ** t)) + 1e-7)


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side as (steps, pages, width), ends filled with zeros, and which steps are inside a page."""
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), pages[0].shape[1])), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], live[:len(p), k] = p, True
    return x, live


# Names that sites give to their parts; `*` in a list of elements stands for no name at all.
MAIN_NAMES = "content main post entry article story body text page single prose markdown blog news detail copy".split()
PART_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topnav links tabs skip toc pagination pager".split(),
    "header": "header masthead top banner site branding logo topbar head title".split(),
    "footer": "footer bottom copyright legal colophon credits foot imprint sitemap".split(),
    "sidebar": "sidebar aside widget rail side related recommended popular trending tags archive widgets more secondary".split(),
    "notice": "cookie consent notice alert gdpr message banner popup modal warning overlay disclaimer privacy toast info".split(),
    "advert": "ad ads advert advertisement sponsored promo banner sponsor promotion adsense commercial partner".split(),
    "form": "form search newsletter subscribe signup login contact subscription register".split(),
    "comments": "comments comment responses discussion replies reply respond disqus thread commentlist feedback reviews".split(),
    "share": "share social follow byline meta author date tools actions".split(),
}
PLAIN_NAMES = "wrapper container row col inner box block grid section module item outer left right center clearfix layout primary md lg x1 x2 c12 css flex".split()
MENU_WORDS = "Home About Contact News Products Login Search Help Blog Shop FAQ Privacy Terms Sitemap Careers Press Support Register Archive".split()


class Layouts:
    """Pages laid out from paragraphs of text, with the label of each block. Every choice is drawn, so no name or place tells all."""

    def __init__(self, paragraphs: list[str], seed: int = 7) -> None:
        self.r = np.random.default_rng(seed)
        self.paragraphs = [p.split() for p in paragraphs if p.split()] or [["text"] * 30]

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, least: int, most: int) -> str:
        source = self.pick(self.paragraphs)
        n = int(self.r.integers(least, most + 1))
        a = int(self.r.integers(max(1, len(source) - n + 1)))
        out = " ".join(source[a:a + n])
        return out.replace("&", "&amp;").replace("<", "&lt;")

    def paragraph(self) -> str:
        kind = self.r.random()
        return self.words(1, 3) if kind < 0.12 else self.words(3, 30) if kind < 0.4 else self.words(25, 140)

    def name(self, names: list[str], telling: float) -> str:
        """A class, id or role made of one or two names, a plain one, or none."""
        if not self.chance(telling):
            return f' class="{self.pick(PLAIN_NAMES)}"' if self.chance(0.5) else ""
        name = self.pick(names) + (self.pick(["-", "_", " "]) + self.pick([*PLAIN_NAMES, *names, "list", "area", "text"]) if self.chance(0.4) else "")
        return f' {self.pick(["class", "class", "class", "id"])}="{name}"'

    def links(self, n: int, tag: str = "li") -> str:
        label = lambda: self.pick(MENU_WORDS) if self.chance(0.4) else self.words(1, 3)
        inner = "".join(f'<{tag}><a href="/{i}">{label()}</a></{tag}>' for i in range(n))
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    def part(self, kind: str) -> str:
        """One part that is no main text."""
        r, names = self.r, PART_NAMES[kind]
        own = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"],
               "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol"], "notice": ["div", "div", "section", "p", "aside"], "advert": ["div", "div", "aside", "p", "section"],
               "share": ["div", "p", "ul"]}[kind]
        tag = self.pick(own)
        # Elements that tell by themselves need no telling name.
        telling = 0.4 if tag in ("nav", "header", "footer", "form") else 0.95
        if kind == "menu":
            inner = self.links(int(r.integers(3, 12)), "li" if tag != "ul" else "li")
        elif kind == "header":
            inner = f"<{self.pick(['div', 'p', 'h1', 'span'])}>{self.words(1, 5)}</div>" + (self.links(int(r.integers(2, 7))) if self.chance(0.5) else "") + (f"<p>{self.words(3, 9)}</p>" if self.chance(0.4) else "")
        elif kind == "footer":
            inner = f"<p>&copy; {self.pick(['2019', '2021', 'example.com', 'www.example.org'])} &middot; {self.words(2, 12)}</p>" if self.chance(0.5) else f"&copy; {self.words(2, 14)}"
            inner += self.links(int(r.integers(2, 8)), self.pick(["li", "a"])) if self.chance(0.5) else ""
        elif kind == "sidebar":
            inner = "".join(f"<h3>{self.words(1, 4)}</h3>" + (self.links(int(r.integers(2, 8))) if self.chance(0.6) else f"<p>{self.words(8, 40)}</p>") for _ in range(int(r.integers(1, 4))))
        elif kind == "notice":
            inner = self.pick(["", "<p>", "<span>"]) + self.words(6, 45) + self.pick(["", "<button>OK</button>", f" <a href='#'>{self.words(1, 3)}</a>", "<button>Accept</button>"])
        elif kind == "advert":
            inner = self.pick(["", "<p>", "<h4>Ad</h4><p>"]) + self.words(4, 40) + self.pick(["", "", f"<a href='x'>{self.words(1, 4)}</a>"])
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=a>" + (f"<p>{self.words(4, 20)}</p>" if self.chance(0.5) else "") + f"<button>{self.pick(['Send', 'Search', 'Subscribe', 'OK'])}</button>"
            inner += "<select><option>a<option>b</select>" if self.chance(0.2) else ""
        elif kind == "comments":
            each = self.pick(["div", "li", "article", "div"])
            one = lambda: (f"<{each}{self.name(PART_NAMES['comments'], 0.6)}>" + (f"<{self.pick(['b', 'h4', 'cite', 'p', 'span'])}>{self.words(1, 3)}</{self.pick(['b', 'p'])}>" if self.chance(0.6) else "")
                           + "".join(f"<p>{self.words(4, 90)}</p>" for _ in range(int(r.integers(1, 3)))) + f"</{each}>")
            inner = (f"<h3>{self.pick(['Comments', 'Responses', '3 comments', self.words(1, 3)])}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(int(r.integers(1, 7))))
        else:
            inner = f"{self.words(1, 6)}" + self.links(int(r.integers(1, 4)), "a")
        return f"<{tag}{self.name(names, telling)}>{inner}</{tag}>"

    def main(self) -> str:
        """The main text; \x01 stands before its blocks, so that they can be told when the page is read."""
        r = self.r
        out = f"<h1>\x01{self.words(2, 12)}</h1>" if self.chance(0.85) else ""
        if out and self.chance(0.15):
            out = f"<header>{out}</header>"
        for _ in range(int(r.integers(1, 16))):
            kind = r.random()
            bold = self.pick(["", "", "", "<b>", "<em>"])
            if kind < 0.72:
                broken = self.chance(0.2)
                out += f"<p>{bold}\x01{self.paragraph()}" + (f" <a href='/z'>{self.words(1, 3)}</a> {self.words(2, 9)}" if self.chance(0.15) else "") + ("<br>" if broken else "</p>")
            elif kind < 0.8:
                out += f"<h{int(r.integers(2, 5))}>\x01{self.words(1, 9)}</h2>"
            elif kind < 0.87:
                out += self.pick(["<ul>", "<ol>"]) + "".join(f"<li>\x01{self.words(2, 30)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>"
            elif kind < 0.91:
                out += f"<blockquote><p>\x01{self.paragraph()}</p></blockquote>"
            elif kind < 0.94:
                out += f"<pre>\x01{self.words(5, 30)}</pre>"
            elif kind < 0.97:
                out += "<table>" + "".join(f"<tr><td>\x01{self.words(1, 5)}<td>\x01{self.words(1, 5)}" for _ in range(int(r.integers(1, 4)))) + "</table>"
            else:
                out += self.part(self.pick(["advert", "advert", "notice", "share", "form"]))
        return out

    def page(self) -> tuple[Page, np.ndarray]:
        some = lambda kinds, p: "".join(self.part(k) for k in kinds if self.chance(p))
        # A fifth of the pages are bare ones: a menu, a notice or two, a text.
        p = 0.5 if self.chance(0.8) else 0.25
        before = some(["notice"], p * 0.6) + some(["header"], p) + some(["menu"], 1.3 * p) + some(["advert", "form"], p * 0.7) + some(["sidebar"], p * 0.4) + some(["advert", "menu"], p * 0.6)
        after = some(["share"], p * 0.6) + some(["advert"], p * 0.6) + some(["comments"], 1.2 * p) + some(["sidebar", "menu"], p * 0.7) + some(["form"], p * 0.6) + some(["footer"], 1.5 * p) + some(["notice"], p * 0.4)
        tag = self.pick(["article", "article", "main", "div", "div", "section", "td"])
        main = self.main() if self.chance(0.97) else ""
        body = f"<{tag}{self.name(MAIN_NAMES, 0.3 if tag in ('article', 'main') else 0.75)}>{main}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        inside = self.chance(0.15)
        if inside:
            body = body.replace(f"</{tag}>", some(["share", "comments"], 0.5) + f"</{tag}>")
        if self.chance(0.4):
            body = f"<div{self.name(MAIN_NAMES + PLAIN_NAMES, 0.5)}>{body}" + (some(["sidebar", "comments"], 0.3)) + "</div>"
        html = f"<html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"
        page = Page(html)
        labels = np.array(["\x01" in t for t in page.texts])
        page.texts = [t.replace("\x01", "") or "x" for t in page.texts]
        return page, labels


def paragraphs_of(pages: list[str]) -> list[str]:
    """Texts of blocks with at least five words, whatever part of their page they are."""
    return [t for html in pages for t in Page(html).texts if t.count(" ") >= 4]


def train(pages: DataFrame, sample: int = SAMPLE, laid_out: int = PAGES) -> Network:
    """A network trained on layouts of texts from a sample of the pages: a share of their hashes that is about `sample` of them."""
    n, space = pages.count(), 1 << 30
    drawn = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(space)) < min(space, sample * space // max(1, n)))
    rows = drawn.where(F.length("html") > 0).limit(2 * sample).select("html").collect()
    layouts = Layouts(paragraphs_of(sorted(r.html for r in rows)))
    known = [p for p in (layouts.page() for _ in range(laid_out)) if p[0].texts]
    network = Network()
    network.train([p for p, _ in known], [y for _, y in known])
    return network


class Extractor:
    def __init__(self, network: Network, least: float = 0.5) -> None:
        self.network, self.least, self.features = network, least, Features()

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main texts of whole pages: blocks judged main, in page order, joined by a blank line."""
        read = [Page(html) for html in pages]
        inputs = [self.network.inputs(p, self.features) if p.texts else np.zeros((0, 0)) for p in read]
        return ["\n\n".join(t for t, s in zip(p.texts, scores) if s >= self.least) for p, scores in zip(read, self.network.judge(inputs))]


def main_texts(pages: DataFrame, network: Network | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text and the text's length in code points.

    A null or empty html, one without text, and one without main text give an empty text. White space inside a block becomes one space, character references
    are decoded, unclosed elements end where HTML ends them. Pages are judged one by one, so repeated rows, ties and other rows change nothing;
    an empty table gives no rows; other columns are not read. Very long pages are read whole, their blocks go through the network as one sequence.
    """
    bounded_batches(pages.sparkSession)
    network = network or train(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = Extractor(network)
        for batch in batches:
            html = texts_of(batch.pop("html"))
            for a in range(0, len(html), 64):
                texts = extractor.texts(html[a:a + 64])
                yield batch.iloc[a:a + 64].assign(text=texts, n_chars=[len(t) for t in texts])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
