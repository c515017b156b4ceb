"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element (and every inline element with a class, id or role) is a
variable with three states: frame (around content), content, furniture.  Its
own potential is a product over features of its text, given its kind of tag;
parent and child are joined by a 3 x 3 potential, chosen by the child's tag
and by what its class, id and role say.  Sum-product messages go up from the
leaves and down from the root, which gives each element's content marginal
exactly; text is kept where the marginal of its nearest element is at least
one half.

Potentials are frequencies in labelled pages: those of ``html_labelled`` and a
sample of the table itself (``SAMPLE_PAGES``, by a hash of the id; the bound
of that sample is a parameter) whose ``article`` or ``main`` elements label
them.  Counting, like extraction, runs in tasks; only sums reach the driver.

A block is the text between two block-level tags; its white space becomes one
space.  Scripts, styles, head, buttons and other controls never give text.

Cases: a null or empty page gives an empty text; mark-up cut off in a tag or
comment loses that tag; a page of text without any tag is one block of it;
repeated rows stay; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpaths.llm.html_labelled import pages as labelled_pages
from readpaths.llm.shared import bounded_batches

SAMPLE_PAGES = 500
SMOOTHING = 0.5
BACKOFF = 0.5  # pseudo-observations that a coarser frequency is worth
TEXT_WEIGHT = 0.7  # features of a text are not independent
BATCH_PAGES = 200
BATCH_CHARS = 8 << 20

# fixed values: element groups of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg select button".split())
TO_THE_END = frozenset("script style title textarea xmp".split())  # raw elements that swallow the rest when never closed
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                   "object math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mtable mtr mtd".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAG_GROUPS = {t: g for g, tags in {
    "article": "article main", "section": "section", "div": "div span", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu li dt dd",
    "table": "table thead tbody tfoot tr td th caption", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset legend label input",
    "quote": "blockquote pre figure figcaption address details summary", "page": "html body"}.items() for t in tags.split()}
# word beginnings in class, id and role, most telling first
CUES = {
    "comment": "comment reply replies discuss disqus respond thread",
    "ad": "ad ads advert advertisement advertising adslot adsense adbox banner promo promotion sponsor sponsored dfp",
    "notice": "notice alert cookie consent gdpr popup modal overlay warning disclaimer toast",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip",
    "form": "form search subscribe subscription newsletter signup login register",
    "sidebar": "sidebar aside widget related recommend recommended trending popular rail complementary",
    "share": "share sharing social follow tags meta byline author",
    "footer": "footer foot copyright legal contentinfo colophon",
    "header": "header head masthead logo topbar branding",
    "content": "article content post entry main story body text blog",
    "frame": "wrapper wrap container page site layout row col inner outer",
}
_CUE = {w: cue for cue, words in CUES.items() for w in words.split()}
_RANK = {cue: i for i, cue in enumerate(CUES)}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKUP = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|gold)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def cue_of(names: str) -> str:
    found = {_CUE[w] for m in _WORD.findall(names) for w in (m.lower(), m.lower().removesuffix("s")) if w in _CUE}
    return min(found, key=_RANK.__getitem__) if found else "none"


class Page:
    """Elements (parent, tag, cue) and text segments (block number, element, text, in a link) of a page."""

    def __init__(self, source: str):
        self.parent, self.tag, self.cue, self.gold = [-1], ["html"], ["none"], [None]
        self.segments: list[tuple[int, int, str, bool]] = []
        self._read(source)

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements with their variable
        places: dict[str, list[int]] = {}  # of the open elements of each tag
        solid: list[int] = []  # places of those that are not inline
        unclosed: set[str] = set()  # tags that no end tag follows any more
        block, links, at, size = 0, 0, 0, len(s)

        def text(piece):
            if piece and not piece.isspace():
                self.segments.append((block, stack[-1][1] if stack else 0, html.unescape(piece), links > 0))
            elif piece:
                self.segments.append((block, -1, " ", False))

        def close(count):
            nonlocal links, block
            for tag, _ in stack[count:]:
                links -= tag == "a"
                block += tag not in INLINE
                places[tag].pop()
                if tag not in INLINE:
                    solid.pop()
            del stack[count:]

        def opened(tag, variable):
            places.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                solid.append(len(stack))
            stack.append((tag, variable))

        def last(tags):
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        while at < size:
            m = _MARKUP.search(s, at)
            if m is None:
                text(s[at:])
                break
            text(s[at : m.start()])
            at = m.start()
            if s.startswith("<!--", at):
                end = s.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if s[at + 1] in "!?":
                end = s.find(">", at)
                at = size if end < 0 else end + 1
                continue
            m = _TAG.match(s, at) or _LOOSE_TAG.match(s, at)
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if places.get(tag):
                    close(places[tag][-1])
                else:
                    block += tag not in INLINE
                continue
            if tag == "br":
                self.segments.append((block, -1, " ", False))
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(s, at)
                if not end:
                    unclosed.add(tag)
                if end or tag in TO_THE_END:
                    stop = s.find(">", end.end()) if end else -1
                    at = size if stop < 0 else stop + 1
                    continue
            if tag in CLOSES_P:
                if solid and stack[solid[-1]][0] == "p":
                    close(solid[-1])
            elif tag in SIBLINGS:
                ends, scope = SIBLINGS[tag]
                while (i := last(ends)) > last(scope):
                    close(i)
                    if tag != "tr":
                        break
            if tag not in INLINE:
                block += 1
            if tag in VOID:
                continue
            if tag == "html" and len(self.parent) == 1:  # the root is there already
                self.gold[0] = dict((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])).get("gold")
                opened(tag, 0)
                continue
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            variable = stack[-1][1] if stack else 0
            if tag not in INLINE or names.strip() or "gold" in found:
                self.parent.append(variable)
                self.tag.append(tag)
                self.cue.append(cue_of(names) if names.strip() else "none")
                self.gold.append(found.get("gold"))
                variable = len(self.parent) - 1
            if m[3].endswith("/") and tag in INLINE:
                continue
            links += tag == "a"
            opened(tag, variable)

    def features(self) -> list[tuple]:
        """Per element: tag group, cue, then the values of ``FEATURES``."""
        n = len(self.parent)
        own, linked, stops = [0] * n, [0] * n, [0] * n
        for _, v, piece, in_link in self.segments:
            if v >= 0:
                size = len(piece.strip())
                own[v] += size
                linked[v] += size if in_link else 0
                stops[v] += piece.count(". ") + piece.count(", ") + piece.rstrip().endswith((".", "!", "?", ":"))
        below, below_linked = own[:], linked[:]
        for v in range(n - 1, 0, -1):  # parents come first
            below[self.parent[v]] += below[v]
            below_linked[self.parent[v]] += below_linked[v]
        out = []
        for v in range(n):
            length = 0 if not own[v] else 1 if own[v] < 25 else 2 if own[v] < 80 else 3 if own[v] < 200 else 4
            share = below_linked[v] / below[v] if below[v] else -1
            density = "none" if share < 0 else "free" if share == 0 else "some" if share < 0.5 else "most"
            bulk = 0 if not below[v] else 1 + sum(10 * below[v] > k * below[0] for k in (1, 4))
            out.append((TAG_GROUPS.get(self.tag[v], "other"), self.cue[v], length, density, min(stops[v], 2) if own[v] else -1, bulk))
        return out

    def labels(self) -> list[int]:
        """States by the inherited ``gold`` marks."""
        states, out = {"1": CONTENT, "0": FURNITURE}, []
        for v, mark in enumerate(self.gold):
            out.append(states.get(mark, out[self.parent[v]] if v else FRAME))
        return out

    def own_labels(self) -> list[int] | None:
        """States by a page's own semantic tags, or None if it has none."""
        if not {"article", "main"} & set(self.tag):
            return None
        holds = [t in ("article", "main") for t in self.tag]
        for v in range(len(holds) - 1, 0, -1):
            holds[self.parent[v]] |= holds[v]
        out = []
        for v, tag in enumerate(self.tag):
            up = out[self.parent[v]] if v else FRAME
            if up == FURNITURE or tag in ("nav", "footer", "aside", "form", "dialog") or self.cue[v] not in ("none", "content", "frame", "header"):
                out.append(FURNITURE)
            elif up == CONTENT or tag in ("article", "main"):
                out.append(CONTENT)
            else:
                out.append(FRAME if holds[v] else FURNITURE)
        return out

    def text(self, keep: np.ndarray) -> str:
        """Blocks of the kept elements' text, one to a line."""
        out, block, parts = [], None, []
        for number, v, piece, _ in [*self.segments, (-1, -1, "", False)]:
            if number != block:
                line = " ".join("".join(parts).split())
                if line:
                    out.append(line)
                block, parts = number, []
            if v < 0 or keep[v]:
                parts.append(piece)
        return "\n".join(out)


FRAME, CONTENT, FURNITURE = range(3)
STATES = (FRAME, CONTENT, FURNITURE)
FEATURES = ("length", "links", "stops", "bulk")


def count_labels(pages: Iterable[tuple[Page, list[int]]]) -> Counter:
    """Frequencies of (kind, value, state): features by tag group; states by the parent's state, tag group and cue."""
    out: Counter = Counter()
    for page, labels in pages:
        for v, ((tag, cue, *values), label) in enumerate(zip(page.features(), labels, strict=True)):
            out["all", "", label] += 1
            for name, value in zip(FEATURES, values, strict=True):
                out[name, f"{tag} {value}", label] += 1
            above = labels[page.parent[v]] if v else "root"
            out["child", f"{above}", label] += 1
            out["child", f"{above} {cue}", label] += 1
            out["child", f"{above} {cue} {tag}", label] += 1
    return out


class Model:
    """Log potentials from frequencies; sparse cases lean on coarser ones."""

    def __init__(self, counts: Counter):
        self.counts = counts
        self.sums = {}
        for (kind, value, label), n in counts.items():
            if kind in FEATURES:
                tag = value.split()[0]
                self.sums[kind, tag, label] = self.sums.get((kind, tag, label), 0) + n
        self.own: dict[tuple, np.ndarray] = {}
        self.joined: dict[tuple, np.ndarray] = {}

    def potential(self, tag: str, values: tuple) -> np.ndarray:
        """log P(features | state, tag group), by state."""
        if (tag, values) not in self.own:
            out = np.zeros(len(STATES))
            for name, value in zip(FEATURES, values, strict=True):
                for label in STATES:
                    n, total = self.counts[name, f"{tag} {value}", label], self.sums.get((name, tag, label), 0)
                    out[label] += TEXT_WEIGHT * np.log((n + SMOOTHING) / (total + 5 * SMOOTHING))
            self.own[tag, values] = out
        return self.own[tag, values]

    def join(self, tag: str, cue: str) -> np.ndarray:
        """log P(state | parent's state, cue, tag group): row by parent (the last row: the root's)."""
        if (tag, cue) not in self.joined:
            out = np.zeros((len(STATES) + 1, len(STATES)))
            for row, above in enumerate([*STATES, "root"]):
                p = np.full(len(STATES), 1 / len(STATES))
                for value in (f"{above}", f"{above} {cue}", f"{above} {cue} {tag}"):
                    n = np.array([self.counts["child", value, label] for label in STATES], dtype=float)
                    p = (n + BACKOFF * p) / (n.sum() + BACKOFF)
                out[row] = np.log(p)
            self.joined[tag, cue] = out
        return self.joined[tag, cue]

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Content marginals of all elements, by messages up and down all the pages' trees at once."""
        sizes = [len(p.parent) for p in pages]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + b, -1) for p, b in zip(pages, begin[:-1].tolist(), strict=True)])
        values = [v for p in pages for v in p.features()]
        belief = np.array([self.potential(tag, rest) for tag, _, *rest in values for rest in [tuple(rest)]])
        edge = np.array([self.join(tag, cue) for tag, cue, *_ in values])
        depth = np.zeros(len(parent), np.int64)
        for v, up in enumerate(parent.tolist()):  # parents come first
            if up >= 0:
                depth[v] = depth[up] + 1
        roots = parent < 0
        belief[roots] += edge[roots, -1]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        upward = np.zeros_like(belief)
        for d in range(len(cuts) - 2, 0, -1):
            v = order[cuts[d] : cuts[d + 1]]
            upward[v] = np.logaddexp.reduce(edge[v, :-1] + belief[v, None, :], axis=2)
            np.add.at(belief, parent[v], upward[v])
        for d in range(1, len(cuts) - 1):
            v = order[cuts[d] : cuts[d + 1]]
            above = belief[parent[v]] - upward[v]
            above -= above.max(axis=1, keepdims=True)
            belief[v] += np.logaddexp.reduce(edge[v, :-1] + above[:, :, None], axis=1)
        belief -= np.logaddexp.reduce(belief, axis=1)[:, None]
        content = np.exp(belief[:, CONTENT])
        return [content[a:b] for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False)]

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        return [p.text(m >= 0.5) for p, m in zip(pages, self.marginals(pages), strict=True)] if pages else []


def labelled_counts() -> Counter:
    furniture = [w for cue, words in CUES.items() if cue not in ("content", "frame") for w in words.split()]
    return count_labels((p, p.labels()) for p in map(Page, labelled_pages(furniture, CUES["content"].split())))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Potentials from the labelled pages and from about ``sample_pages`` pages of the table."""
    n = pages.count()
    sample = pages.where(F.pmod(F.xxhash64(F.col(id_col), F.col(html_col)), F.lit(max(n, 1))) < sample_pages).select(F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = (Page(x.as_py()) for x in b.column("html") if x.as_py())
            counts = count_labels((p, labels) for p in read if (labels := p.own_labels()) is not None)
            kinds, values, labels = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(labels, pa.int32()), pa.array(counts.values(), pa.int64())],
                                             names=["kind", "value", "label", "n"])

    sums = sample.mapInArrow(run, "kind string, value string, label int, n long").groupBy("kind", "value", "label").agg(F.sum("n").alias("n"))
    own = {(r["kind"], r["value"], r["label"]): r["n"] for r in sums.collect()}  # a row per feature value
    counts = labelled_counts()
    # the table's pages together weigh as much as the labelled set
    share = sum(counts["all", "", x] for x in STATES) / max(1, sum(own.get(("all", "", x), 0) for x in STATES))
    return Model(counts + Counter({k: v * share for k, v in own.items()}))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """``<id_col>, <url_col>, text, n_chars`` of every page."""
    bounded_batches(pages.sparkSession)
    learned = train(pages, id_col, html_col) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = [x or "" for x in b.column("html").to_pylist()]
            i = 0
            while i < len(sources):
                j, size = i, 0
                while j < len(sources) and j - i < BATCH_PAGES and (j == i or size + len(sources[j]) <= BATCH_CHARS):
                    size += len(sources[j])
                    j += 1
                texts = learned.texts(sources[i:j])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("url").slice(i, j - i), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
                i = j

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
