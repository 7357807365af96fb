"""Main text of web pages by the best-scoring contiguous region.

A page is read as one sequence of words and tags. Words score positive and tags negative, by
weights fitted on labelled pages (``pagelabels``); a linear scan finds the contiguous run of
highest total. Words within elements whose names speak against an article (tag, role, and whole
class and id names, by their log odds on the labelled pages) lose that much, so that menus,
sidebars or comments score negative: the run ends before them, or bridges them without taking
them. Of the run, widened to the innermost container that holds all of it, the text is that of
the words that score positive.

Names never decide against the words: an element whose name is only like those of the labelled
pages counts as part of the article if it holds more words than all that is left without it,
and any element if almost nothing is left.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.bpe import each_text
from quillstone.llm.pagelabels import MARK, labelled_pages

# Names of HTML elements by how they are read.
RAW = frozenset("script style noscript template iframe textarea title select".split())
HEAD = frozenset("head title base basefont bgsound link meta style script noscript noframes template".split())  # what may stand in a head
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p dt dd li h1 h2 h3 h4 h5 h6 option".split())  # often left open
HOLDERS = BLOCK - LEAF - {"html", "body"}  # what a region is widened to
#: Elements whose text is never an article's, whatever the labelled pages have.
CONTROLS = frozenset("head label fieldset option button legend".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-label)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
NAME_PARTS = re.compile(r"[A-Za-z]+")
_ends = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in RAW}


def _features(name: str, attributes: str, within_main: bool) -> tuple[str, ...]:
    """What an element's name and marks say of it: ``tag:``, ``role:``, ``hidden`` and, by class and id, ``name:``."""
    found = [f"tag:{'inner-' if within_main and name == 'header' else ''}{name}"]
    if "=" in attributes or "hidden" in attributes.lower():
        for m in MARKS.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden":
                found.append("hidden")
            elif key == "role":
                found += [f"role:{v}" for v in value.split()]
            elif key in ("class", "id"):
                found += [f"name:{v}" for v in value.split()]
    return tuple(found)


@dataclass(slots=True)
class Element:
    """An element that can hold blocks, or has marks: its features, parent and (start, end) among the entries."""

    name: str
    features: tuple[str, ...]
    parent: int
    start: int
    end: int = -1


@dataclass(slots=True)
class Page:
    """Entries (kind, text, element) in page order, and the elements; the first stands for the page itself."""

    entries: list[tuple[str, str, int]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", (), -1, 0)])


def read(page: str) -> Page:
    """Lexes a page; the words of a run are one entry, and each tag is one."""
    out = Page()
    entries, elements = out.entries, out.elements
    stack = [0]
    open_count: Counter = Counter()
    link, at, n, mains = 0, 0, len(page), 0

    def pop() -> Element:
        e = elements[stack.pop()]
        e.end = len(entries)
        open_count[e.name] -= 1
        return e

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        name = (m["name"] or "").lower()
        # </head> may be left out: the first words, or the first tag that can't stand in a head, end it
        while elements[stack[-1]].name == "head" and (text.strip() if text is not None else name and not m["close"] and name not in HEAD):
            pop()
        if text is not None:
            entries.append(("link" if link else "word", text, stack[-1]))
            continue
        if not name:
            continue
        if name in RAW and not m["close"]:
            end = _ends[name].search(page, at)
            at = end.end() if end else n
            entries.append(("break", "", stack[-1]))
            continue
        if name == "a":
            link = 0 if m["close"] else 1
        block = name in BLOCK
        kind = ("main" if name in MAIN else "leaf" if name in LEAF else "box") if block else "break" if name == "br" else "inline"
        if m["close"]:
            if open_count[name]:
                while pop().name != name:
                    pass
            entries.append((f"/{kind}" if block else kind, "", stack[-1]))
            continue
        if name in VOID:  # a rule across the text holds nothing
            entries.append((kind, "", stack[-1]))
            continue
        if block:  # open paragraphs, headings and inline marks end where a block starts, and an item at the next
            while (top := elements[stack[-1]].name) and (top not in BLOCK or top in LEAF and top not in ("li", "dd", "dt", "option") or top == name and name in LEAF):
                pop()
        features = _features(name, m["attributes"], any(open_count[x] for x in MAIN))
        if name in MAIN and len(features) == 1 and not mains:  # an element left open before the first article doesn't hold it
            mains += 1
            while len(stack) > 1 and elements[stack[-1]].name not in ("html", "body") and not _closes(page, at, elements[stack[-1]].name, name):
                pop()
        if block or len(features) > 1:
            elements.append(Element(name, features, stack[-1], len(entries)))
            stack.append(len(elements) - 1)
            open_count[name] += 1
        entries.append((kind, "", stack[-1]))
    while len(stack) > 1:
        pop()
    elements[0].end = len(entries)
    return out


def _closes(page: str, at: int, name: str, inner: str) -> bool:
    """Whether an element of this name ends after the next end of ``inner``."""
    end = re.compile(rf"</{inner}\b", re.I).search(page, at)
    return bool(end and re.compile(rf"</{name}\b", re.I).search(page, end.end()))


@dataclass
class Weights:
    """Score of a word and of tags by kind, and what an element's names take from the words within."""

    kinds: dict[str, float]
    names: dict[str, float]
    parts: dict[str, float]

    def against(self, element: Element) -> tuple[float, bool]:
        """Evidence that an element is no part of an article, and whether its names are known ones."""
        if element.name in ("", "html", "body"):
            return 0.0, True
        if element.name in CONTROLS:
            return 9.0, True
        known = [self.names[f] for f in element.features if f in self.names]
        strange = 0.0
        for f in element.features:
            if f not in self.names and f.startswith("name:"):
                strange += max(-1.0, min(2.5, sum(self.parts.get(p, 0.0) for p in NAME_PARTS.findall(f[5:]))))
        return sum(known) + strange, sum(known) > 1.0


def fit(pages: list[str] | None = None) -> Weights:
    """Log odds of kinds of entries, names and parts of names, from labelled pages."""
    inside, outside = Counter(), Counter()
    names = (Counter(), Counter())
    for page in pages or labelled_pages():
        seen = read(page)
        marks = [MARK in text for _, text, _ in seen.entries]
        first, last = marks.index(True), len(marks) - 1 - marks[::-1].index(True)
        for i, (kind, text, _) in enumerate(seen.entries):
            own = marks[i] if text else first <= i <= last
            (inside if own else outside)[kind] += max(1, len(text.split()))
        for e in seen.elements[1:]:
            holds = any(marks[e.start : e.end])
            for f in set(e.features):
                names[not holds][f] += 1
    odds = lambda pair, x: math.log((pair[1][x] + 0.2) / (pair[0][x] + 0.2))
    kinds = {}
    for f in ("word", "link", "inline", "break", "leaf", "/leaf", "box", "/box", "main", "/main"):
        o = math.log((inside[f] + 1) / (outside[f] + 1))
        kinds[f] = min(1.5, max(0.5, o)) if f == "word" else max(0.05, o / 4) if f == "link" else min(-0.05, o - 1)
    kinds["main"] = kinds["/main"] = min(kinds.values())
    plain = [f"tag:{x}" for x in BLOCK - frozenset("nav header footer aside form dialog menu button".split())]
    known = {f: odds(names, f) for f in {*names[0], *names[1]} if f not in plain}
    return Weights(kinds, known, _part_weights({f[5:]: v for f, v in known.items() if f.startswith("name:")}))


def _part_weights(names: dict[str, float], rounds: int = 2000, decay: float = 0.02) -> dict[str, float]:
    """What parts of names say, by logistic regression over the known names: in ``has-sidebar`` the first outweighs the second."""
    split = [NAME_PARTS.findall(n) for n in names]
    parts = sorted({p for x in split for p in x})
    at = {p: k for k, p in enumerate(parts)}
    x = np.zeros((len(split), len(parts)))
    for i, some in enumerate(split):
        x[i, [at[p] for p in some]] = 1.0
    y = np.array([v > 0 for v in names.values()], float)
    w = np.zeros(len(parts))
    for _ in range(rounds):
        w -= 4.0 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + decay * w / len(y))
    return dict(zip(parts, w.tolist()))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of highest total; the first and shortest of equals."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


WEIGHTS = fit()
#: Words that must be left where an element is taken out by its names alone.
LEFT = 10


def _losses(page: Page, weights: Weights) -> list[float]:
    """What each element takes from the words within it, those of the elements around it included."""
    n = len(page.elements)
    own, known = zip(*(weights.against(e) for e in page.elements))
    own = [max(0.0, x) for x in own]
    words = [0] * n  # of each element, without those in elements within
    for kind, text, e in page.entries:
        if kind == "word":
            words[e] += len(text.split())
    for _ in range(n):
        total, least = [0.0] * n, weights.kinds["word"]
        for i, e in enumerate(page.elements):
            total[i] = own[i] + (total[e.parent] if e.parent >= 0 else 0.0)
        left = sum(w for w, t in zip(words, total) if t < least)
        held, freed = [0] * n, [0] * n  # words of an element's outermost loss, and those that its own loss alone takes
        top = [-1] * n
        for i, e in enumerate(page.elements):
            above = top[e.parent] if e.parent >= 0 else -1
            top[i] = above if above >= 0 else i if own[i] >= least else -1
            if top[i] >= 0:
                held[top[i]] += words[i]
                freed[top[i]] += words[i] * (total[i] - own[top[i]] < least)
        lift = [i for i in range(n) if top[i] == i and freed[i] and page.elements[i].name not in CONTROLS]
        lift = [i for i in lift if (left < LEFT and freed[i] > 2 * LEFT) or (not known[i] and freed[i] > left)]
        if not lift:
            return total
        own[max(lift, key=lambda i: (freed[i], -i))] = 0.0
    return total


def extract_text(html: str | None, weights: Weights = WEIGHTS) -> str:
    """The article's blocks joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    page = read(html)
    loss = _losses(page, weights)
    scores = []
    for kind, text, e in page.entries:
        each = weights.kinds[kind]
        scores.append((each - loss[e]) * len(text.split()) if text else each)
    start, end = best_region(scores)
    if start < end:
        around = ((e.start, e.end) for e in page.elements if e.start <= start and end <= e.end and e.name in HOLDERS)
        start, end = min(around, key=lambda x: x[1] - x[0], default=(start, end))
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    taken = weights.kinds["word"]
    for kind, text, e in page.entries[start:end]:
        if kind not in ("word", "link", "inline", "break"):
            close()
        elif loss[e] >= taken:
            if parts and page.elements[e].name in BLOCK:
                close()
        elif text:
            parts.append(text)
        elif kind == "break":
            parts.append(" ")
    close()
    return "\n\n".join(blocks)


@F.arrow_udf(T.StringType())
def _extracted(pages: pa.Array) -> pa.Array:
    return pa.array([extract_text(p) for p in each_text(pages)], pa.string())


def main_text(html: Column) -> Column:
    """The main text of each whole page.

    Null and empty pages, and those without words that score positive, give an empty string. Of
    regions of equal score the first and shortest is taken. The result depends on the page
    alone, so repeated rows have equal texts and an empty table gives none; time is in
    proportion to the page's length but for the few rounds in which names are overruled.
    """
    return _extracted(html)
