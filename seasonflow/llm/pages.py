"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: stretches of text between the borders of block elements, with the elements around
them. Each block has features of its ancestors (tags, roles, words of class and id, those of the nearest telling
ancestor once more) and of its text (length, links, punctuation, place). The field has two states, main text and the
rest; its steps weigh apart those within one container and those into another. It is trained on labelled pages, pairs
of HTML and main text, by maximum likelihood with a Gaussian prior, and a page is decoded by Viterbi. The weights of
known features (bounded by the labelled pages' vocabulary) are all that goes to the tasks.

Defined results: null or empty HTML, and pages without text, give an empty text. Character references are decoded,
white space within a block (line breaks by <br> too) is one space, blocks are trimmed and joined by line feeds in page
order. Scripts, styles, templates, comments, titles and what else isn't shown as text are no blocks. Tags that are cut
off by the end of the page are dropped, unclosed elements end with the page. Rows that repeat an id are pages of
their own.
"""

from __future__ import annotations

import difflib
import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import fresh

TAG = re.compile(
    r"<(?:(?P<comment>!--(?:-?>|.*?(?:--!?>|\Z)))"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))", re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and subtrees that show no text.
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in "script style title textarea iframe noembed noframes xmp".split()}
SILENT = set("template noscript svg canvas object audio video datalist".split())
#: Tags that end an svg element left open.
OUT_OF_SVG = set("article aside blockquote body div dl footer form h1 h2 h3 h4 h5 h6 header li main nav ol p section table ul".split())
#: A start tag of the first ends an open one of the second, within the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})
}
LEAVES = set("p li td th dt dd h1 h2 h3 h4 h5 h6 pre figcaption caption option button summary legend address".split())
TELLING = set("nav header footer aside form article main section".split())


class Element(NamedTuple):
    """An open block element: traits of its own, of it and its ancestors, of the nearest telling one, and its container."""

    tag: str
    own: frozenset
    around: frozenset
    near: frozenset
    container: int


class Block(NamedTuple):
    text: str
    element: Element
    inline: frozenset
    linked: int


def traits(tag: str, attrs: str) -> frozenset:
    """What an element says of itself: its tag, role, whether it's hidden, words of class and id and their beginnings."""
    found = {tag}
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "aria-label"):
            for w in WORD.findall(value)[:40]:
                found |= {f".{w.lower()}", f"^{w[:4].lower()}"}
        elif key == "role":
            found.add(f"@{value.strip().lower()}")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            found.add("@hidden")
    return frozenset(found)


def blocks(page: str, known: dict[tuple[str, str], frozenset] | None = None) -> tuple[list[Block], str]:
    """The leaf blocks of a page in order, and its title. known keeps traits by tag and attributes between pages."""
    known = {} if known is None else known
    out: list[Block] = []
    none = frozenset()
    stack = [Element("", none, none, none, 0)]
    open_: Counter = Counter()
    piece: list[str] = []
    inline: set[str] = set()
    silent: list[str] = []
    title, at, links, linked, containers = "", 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append(Block(text, stack[-1], frozenset(inline), linked))
            piece.clear()
        inline.clear()
        linked = 0

    def pop() -> None:
        open_[stack.pop().tag] -= 1

    def say(raw: str) -> None:
        nonlocal linked
        if not silent:
            text = references.unescape(raw) if "&" in raw else raw
            piece.append(text)
            if links:
                linked += len(text.strip())

    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None or page[at - 1] != ">":
            continue
        name = name.lower()
        if silent and silent[-1] == "svg" and name in OUT_OF_SVG:
            silent.clear()
        if silent:
            # within a subtree without text only its own kind is counted
            if name == silent[-1] and m["end"]:
                silent.pop()
            elif name == silent[-1] and not m["attrs"].endswith("/"):
                silent.append(name)
            elif name in RAW and not m["end"]:
                stop = RAW[name].search(page, at)
                at = stop.start() if stop else len(page)
            continue
        if name == "br":
            piece.append(" ")
            continue
        if m["end"]:
            if name == "a":
                links = 0
            elif name not in INLINE:
                flush()
                if open_[name] > 0:
                    links = 0
                    while stack[-1].tag != name:
                        pop()
                    pop()
            continue
        if name in RAW:
            if name != "title":
                flush()
            stop = RAW[name].search(page, at)
            if name == "title" and not title:
                title = " ".join(references.unescape(page[at : stop.start() if stop else len(page)]).split())
            at = stop.start() if stop else len(page)
            continue
        if name in INLINE:
            inline.add(name)
            links = 1 if name == "a" else links
            continue
        flush()
        if name in VOID:
            continue
        if name in SILENT:
            if not m["attrs"].endswith("/"):
                silent.append(name)
            continue
        if stack[-1].tag == "p":
            pop()
        if name in ENDS:
            closed, within = ENDS[name]
            if any(open_[c] > 0 for c in closed):
                k = len(stack) - 1
                while k and stack[k].tag not in closed and stack[k].tag not in within:
                    k -= 1
                if stack[k].tag in closed:
                    if name == "tr" and stack[k].tag != "tr" and stack[k - 1].tag == "tr":
                        k -= 1
                    while len(stack) > k:
                        pop()
        up = stack[-1]
        if name in ("html", "body"):
            own = none
        else:
            key = (name, m["attrs"])
            own = known.get(key)
            if own is None:
                own = traits(*key)
                if len(known) < 20_000 and len(key[1]) < 300:
                    known[key] = own
        around = up.around if own <= up.around else up.around | own
        near = own if len(own) > 1 or name in TELLING else up.near
        if name not in LEAVES:
            containers += 1
        stack.append(Element(name, own, around, near, up.container if name in LEAVES else containers))
        open_[name] += 1
    flush()
    return out, title


def bucket(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


def text_traits(b: Block, place: float, title: str) -> list[str]:
    text, words = b.text, b.text.count(" ") + 1
    ends = text[-1]
    return [
        f"words{bucket(words, 2, 4, 8, 16, 32, 64)}", f"links{bucket(b.linked / len(text), 0.01, 0.25, 0.5, 0.9)}", f"place{bucket(place, 0.05, 0.2, 0.8, 0.95)}",
        "stop" if ends in ".!?…\"”»。" else "colon" if ends in ":;" else "open", f"commas{bucket(text.count(',') / words, 0.02, 0.1)}",
        f"stops{bucket(text.count('. ') + text.count('? ') + text.count('! '), 1, 3)}",
        "mark" if "©" in text or "|" in text or "·" in text or "»" in text else "plain", "upper" if text[0].isupper() else "lower",
        f"digits{bucket(sum(c.isdigit() for c in text[:200]) / min(len(text), 200), 0.05, 0.3)}",
        "title" if title and (text == title or (words > 2 and (text in title or title.startswith(text)))) else "other"
    ]


class Model(NamedTuple):
    """Weights for the main state: by trait around, near, of the block's own element, of inline elements, of the text; and by step.

    steps[changed][a][b]: from state a to state b, within a container (0) or into another (1); ends: first and last main.
    """

    weights: dict[str, float]
    steps: tuple
    ends: tuple[float, float]


def features(found: list[Block], title: str) -> Iterator[tuple[list[str], frozenset, frozenset]]:
    """For each block: names of its own features, traits around it, traits of the nearest telling ancestor."""
    for k, b in enumerate(found):
        own = [f"t:{x}" for x in text_traits(b, k / len(found), title)]
        own.append(f"tag:{b.element.tag}")
        own += [f"in:{x}" for x in b.inline]
        yield own, b.element.around, b.element.near


def score(found: list[Block], title: str, w: dict[str, float], kept: dict) -> list[float]:
    """The main state's score of each block; kept has the sums over sets of traits."""
    out = []
    for own, around, near in features(found, title):
        total = sum(w.get(x, 0.0) for x in own) + w["bias"]
        for kind, s in (("a:", around), ("n:", near)):
            if (part := kept.get((kind, s))) is None:
                part = sum(w.get(kind + x, 0.0) for x in s)
                if len(kept) < 20_000:
                    kept[(kind, s)] = part
            total += part
        out.append(total)
    return out


def changes(found: list[Block]) -> list[int]:
    return [int(a.element.container != b.element.container) for a, b in zip(found, found[1:])]


def viterbi(scores: list[float], changed: list[int], model: Model) -> list[bool]:
    """The likeliest states: true is main text. Ties go to the rest."""
    if not scores:
        return []
    rest, main = 0.0, scores[0] + model.ends[0]
    back = []
    for s, c in zip(scores[1:], changed):
        (rr, rm), (mr, mm) = model.steps[c]
        back.append((main + mr > rest + rr, main + mm > rest + rm))
        rest, main = max(rest + rr, main + mr), max(rest + rm, main + mm) + s
    state = main + model.ends[1] > rest
    out = [state]
    for b in reversed(back):
        state = b[state]
        out.append(state)
    return out[::-1]


def main_text(page: str, model: Model, known: dict, kept: dict) -> tuple[str, int, int]:
    """(main text, blocks, blocks kept) of a page."""
    found, title = blocks(page, known)
    if not found:
        return "", 0, 0
    states = viterbi(score(found, title, model.weights, kept), changes(found), model)
    main = [b.text for b, s in zip(found, states) if s]
    return "\n".join(main), len(found), len(main)


def labels(found: list[Block], text: str) -> np.ndarray:
    """1 for blocks that are lines of the main text, aligned in order."""
    lines = [" ".join(x.split()) for x in text.split("\n")]
    own = np.zeros(len(found), np.int64)
    for a, _, n in difflib.SequenceMatcher(None, [b.text for b in found], [x for x in lines if x], autojunk=False).get_matching_blocks():
        own[a : a + n] = 1
    return own


def sample(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most_pages: int = 1000, most_chars: int = 50_000_000) -> list[tuple[str, str]]:
    """At most most_pages labelled pages of at most most_chars in all, drawn by their hash: what the field is trained on."""
    cost = F.length(html_col) + F.length(text_col)
    drawn = labelled.where(cost.isNotNull() & (cost <= most_chars // most_pages)).orderBy(F.xxhash64(html_col, text_col)).limit(most_pages)
    return [(r[0], r[1]) for r in drawn.select(html_col, text_col).collect()]


def train(labelled: Iterable[tuple[str, str]], rounds: int = 200, prior: float = 0.02, least: int = 3) -> Model:
    """The field of greatest penalised likelihood on pairs (html, main text); features seen on fewer than `least` pages are left out."""
    parsed = [(*blocks(h), t) for h, t in labelled]
    parsed = sorted(((b, title, labels(b, t)) for b, title, t in parsed if b), key=lambda x: len(x[0]))
    named = [[own + [f"a:{x}" for x in around] + [f"n:{x}" for x in near] for own, around, near in features(b, title)] for b, title, _ in parsed]
    seen = Counter(x for page in named for x in {x for row in page for x in row})
    names = {x: k for k, x in enumerate(["bias", *sorted(x for x, n in seen.items() if n >= least)])}
    groups = []
    for first in range(0, len(parsed), step := max(1, -(-len(parsed) // 6))):
        own = parsed[first : first + step]
        most = len(own[-1][0])
        y, there, changed = np.zeros((len(own), most), np.int64), np.zeros((len(own), most), bool), np.zeros((len(own), most), np.int64)
        at, of = [], []
        for k, (b, _, states) in enumerate(own):
            y[k, : len(b)], there[k, : len(b)], changed[k, 1 : len(b)] = states, True, changes(b)
            for i, row in enumerate(named[first + k]):
                ids = [0, *[names[x] for x in row if x in names]]
                at += [k * most + i] * len(ids)
                of += ids
        groups.append((np.array(at, np.int64), np.array(of, np.int64), y, there, changed))
    n, size = len(names), len(names) + 10
    theta, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1 if parsed else 1):
        grad = (sum(gradient(theta, n, *g) for g in groups) - prior * theta) / len(parsed)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += 0.2 * (1 - 0.9 * step / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    steps = tuple(tuple(tuple(float(x) for x in row) for row in kind) for kind in theta[n : n + 8].reshape(2, 2, 2))
    return Model({x: float(theta[k]) for x, k in names.items()}, steps, (float(theta[n + 8]), float(theta[n + 9])))


def gradient(theta: np.ndarray, n: int, at: np.ndarray, of: np.ndarray, y: np.ndarray, there: np.ndarray, changed: np.ndarray) -> np.ndarray:
    """Of the log likelihood of all pages: observed minus expected counts, by forward and backward sums in logarithms."""
    pages, most = y.shape
    main = np.bincount(at, theta[of], pages * most).reshape(pages, most)
    every, last = np.arange(pages), there.sum(1) - 1
    main[:, 0] += theta[n + 8]
    main[every, last] += theta[n + 9]
    (rr, rm), (mr, mm) = np.moveaxis(theta[n : n + 8].reshape(2, 2, 2)[changed], (2, 3), (0, 1))
    # logarithms of forward sums and backward sums, for the states rest and main
    fr, fm, br, bm = (np.zeros((pages, most)) for _ in range(4))
    fm[:, 0] = main[:, 0]
    for i in range(1, most):
        k = there[:, i]
        fr[:, i] = np.where(k, np.logaddexp(fr[:, i - 1] + rr[:, i], fm[:, i - 1] + mr[:, i]), fr[:, i - 1])
        fm[:, i] = np.where(k, np.logaddexp(fr[:, i - 1] + rm[:, i], fm[:, i - 1] + mm[:, i]) + main[:, i], fm[:, i - 1])
    for i in range(most - 2, -1, -1):
        k, to = there[:, i + 1], main[:, i + 1] + bm[:, i + 1]
        br[:, i] = np.where(k, np.logaddexp(rr[:, i + 1] + br[:, i + 1], rm[:, i + 1] + to), 0)
        bm[:, i] = np.where(k, np.logaddexp(mr[:, i + 1] + br[:, i + 1], mm[:, i + 1] + to), 0)
    whole = np.logaddexp(fr[:, -1], fm[:, -1])[:, None]
    p = np.where(there, np.exp(fm + bm - whole), 0)
    miss = y - p
    out = np.zeros_like(theta)
    out[:n] = np.bincount(of, miss.ravel()[at], n)
    out[n + 8], out[n + 9] = miss[:, 0].sum(), miss[every, last].sum()
    for j, move in enumerate((rr, rm, mr, mm)):
        a, b = divmod(j, 2)
        pair = (fm if a else fr)[:, :-1] + move[:, 1:] + (main + bm if b else br)[:, 1:] - whole
        over = ((y[:, :-1] == a) & (y[:, 1:] == b)) - np.exp(np.where(there[:, 1:], pair, -np.inf))
        over = np.where(there[:, 1:], over, 0)
        out[n + j], out[n + 4 + j] = over[changed[:, 1:] == 0].sum(), over[changed[:, 1:] == 1].sum()
    return out


def extract(pages: DataFrame, model: Model, html_col: str = "html", out: str = "main") -> DataFrame:
    """pages with a struct `out`: text, n_blocks and n_kept."""
    schema = pa.struct([("text", pa.string()), ("n_blocks", pa.int32()), ("n_kept", pa.int32())])

    @F.arrow_udf("struct<text:string,n_blocks:int,n_kept:int>")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, kept = {}, {}
        for b in batches:
            rows = [main_text(x or "", model, known, kept) for x in b.to_pylist()]
            yield pa.array([{"text": t, "n_blocks": n, "n_kept": k} for t, n, k in rows], schema)

    own = fresh(pages, "extracted")
    done = pages.withColumn(own, extracted(F.col(html_col).cast("string")))
    return done.drop(*[c for c in pages.columns if c.lower() == out.lower()]).withColumnRenamed(own, out)
