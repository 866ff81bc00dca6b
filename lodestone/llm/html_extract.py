"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A tolerant tokenizer keeps a stack of open tags and cuts the page into leaf blocks: runs of text between block-level
tags. Each block has binary features of its ancestors' tags and of its text (length, link share, punctuation,
digits, ...). A two-label field (boilerplate, content) is trained by maximum likelihood (forward-backward,
Adam) on the labelled pages of ``labelled_pages`` and decodes pages by Viterbi, many pages at once.

The field is trained on ``PAGES`` labelled pages in ``ROUNDS`` rounds.

Defined results: null id: row ignored. Null or empty html, or one without text: no blocks and an empty text. Scripts,
styles, comments, titles, selections and other hidden elements are no blocks. Optional tags may be missing: a head ends at the first tag or text that
it can't hold, a paragraph at the next block, list items, cells and options at the next one. Unclosed and stray tags, and
unfinished comments, are tolerated; of unclosed elements only scripts, styles and the like hide the rest of the page. Pages are parsed whole. Each row is its own page: repeated rows give repeated
results. An empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import _words as W
from ._arrow import select_text

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<",
    re.S,
)
#: Elements whose content is no text of the page. Those of RAW go on to the end of the page if they aren't closed, as browsers have it; of
#: the others an unclosed tag hides nothing.
RAW = frozenset("script style textarea iframe xmp".split())
HIDDEN = RAW | frozenset("noscript template svg math title select".split())
_CLOSE = {t: re.compile(rf"</{t}\s*+>", re.I) for t in HIDDEN}
#: What a head may hold; any other tag, and any text, ends it.
HEAD = frozenset("title meta link base style script noscript template head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these closes an open one, if nothing of FENCE was opened in between; a block closes a paragraph.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CLOSES |= {t: {"p"} for t in "p address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
FENCE = frozenset("ul ol dl table div section article main nav aside header footer body form blockquote td th li dd figure".split())
TAGS = "html body div section article main nav aside header footer ul ol li dl dt dd table tbody tr td th p h1 h2 h3 h4 h5 h6 blockquote pre form button figure figcaption address a address details summary fieldset".split()

_TAG = {t: i for i, t in enumerate(dict.fromkeys(TAGS))}
_N = len(_TAG)
OTHER = _N
#: Feature numbers: tag of the leaf, its parent, any ancestor, then depth, text and place.
LEAF, PARENT, ABOVE = 0, _N + 1, 2 * (_N + 1)
DEPTH, CHARS, WORDS, LINKS = 3 * (_N + 1), 3 * (_N + 1) + 8, 3 * (_N + 1) + 16, 3 * (_N + 1) + 24
FLAGS = LINKS + 5
SIZE = FLAGS + 12
_END, _LETTER, _DIGIT = re.compile(r"[.!?…]['\"”)]*\s*$"), re.compile(r"\w"), re.compile(r"\d")
_SPACE = re.compile(r"\s+")

#: Labelled pages on which the field is trained, and rounds over them.
PAGES, ROUNDS = 400, 150

Block = tuple[tuple[str, ...], str, int]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page: open tags, text, characters inside links."""
    out: list[Block] = []
    stack: list[str] = []
    text: list[str] = []
    links = depth_a = 0

    def flush() -> None:
        nonlocal links
        if text:
            t = _SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
            if t:
                out.append((tuple(x for x in stack if x not in INLINE) or ("body",), t, links))
            text.clear()
        links = 0

    page, at, head, unclosed = page or "", 0, False, set()
    tokens = _TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        name = m.group(2)
        if name is None:
            t = m.group()
            if t[0] != "<" or len(t) == 1:
                if head and not t.isspace():
                    head = False
                if not (stack and stack[-1] in ("option", "optgroup")):
                    text.append(t)
                    if depth_a:
                        links += len(t.strip())
            continue
        name = name.lower()
        if name == "head":
            head = not m.group(1)
            continue
        if name in HIDDEN and not m.group(1):
            end = None if name in unclosed else _CLOSE[name].search(page, m.end())
            if end:
                tokens = _TOKEN.finditer(page, end.end())
            elif name in RAW:
                break
            else:
                unclosed.add(name)  # no later one is closed either
                if name == "title":  # a title ends with its line of text
                    at = page.find("<", m.end())
                    tokens = _TOKEN.finditer(page, at if at >= 0 else len(page))
            if name not in HEAD:
                head = False
            continue
        if name in HIDDEN:
            continue
        head = head and name in HEAD
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                depth_a = 0 if m.group(1) else 1
            continue
        flush()
        depth_a = 0
        if m.group(1):
            if name in stack:
                while stack.pop() != name:
                    pass
        elif name not in VOID:
            if name not in ("option", "optgroup"):
                while stack and stack[-1] in ("option", "optgroup"):  # of a select that wasn't closed
                    stack.pop()
            closes = CLOSES.get(name)
            if closes:
                last = None
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in closes:
                        last = i
                    elif stack[i] in FENCE:
                        break
                if last is not None:
                    del stack[last:]
            stack.append(name)
    flush()
    return out


def _bucket(n: int) -> int:
    return min(7, n.bit_length() * 2 // 3 if n < 4096 else 7)


def features(found: list[Block]) -> list[list[int]]:
    """Numbers of the features that each block has."""
    out = []
    n = len(found)
    for i, (tags, text, links) in enumerate(found):
        known = [_TAG.get(t, OTHER) for t in tags]
        size, words = len(text), text.count(" ") + 1
        share = links / size
        f = [LEAF + known[-1], PARENT + (known[-2] if len(known) > 1 else OTHER), *(ABOVE + t for t in set(known[:-1]))]
        f += [DEPTH + min(7, len(known)), CHARS + _bucket(size), WORDS + _bucket(words), LINKS + (0 if links == 0 else 1 if share < 0.25 else 2 if share < 0.6 else 3 if share < 0.9 else 4)]
        end = bool(_END.search(text[-8:]))
        commas = text.count(",")
        marks = [end, commas > 0, commas >= 3, "©" in text or "(c)" in text, bool(_DIGIT.search(text)), text.isupper(), text[:1].islower(), i == 0, i == n - 1, end and words >= 10, "|" in text or "·" in text or "»" in text, not _LETTER.search(text)]
        f += [FLAGS + k for k, x in enumerate(marks) if x]
        out.append(f)
    return out


class Field:
    """Weights of the conditional random field: label 1 is content."""

    def __init__(self):
        self.emit, self.move, self.start = np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2)

    @staticmethod
    def flat(pages: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers of all blocks, where each block's start, and where each page's blocks start."""
        every = [f for p in pages for f in p]
        first = np.cumsum([0, *map(len, every)])
        return np.fromiter((x for f in every for x in f), np.int64, int(first[-1])), first, np.cumsum([0, *map(len, pages)])

    def scores(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros((0, 2))
        return np.add.reduceat(self.emit[numbers], first[:-1], axis=0)

    def decode(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """Viterbi: labels of each page's blocks; all pages advance together, the longest first."""
        numbers, first, ptr = self.flat(pages)
        e = self.scores(numbers, first)
        size = np.diff(ptr)
        order = np.argsort(-size, kind="stable")
        sizes, begin = size[order], ptr[:-1][order]
        steps = int(sizes[0]) if len(sizes) else 0
        back = np.zeros((len(e), 2), np.int8)
        live = int((sizes > 0).sum())
        v = np.zeros((len(pages), 2))
        v[:live] = self.start + e[begin[:live]]
        for t in range(1, steps):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # pages longer than t
            x = v[:n, :, None] + self.move
            best = x.argmax(1)
            back[begin[:n] + t] = best
            v[:n] = np.take_along_axis(x, best[:, None], 1)[:, 0] + e[begin[:n] + t]
        labels = np.zeros(len(e), np.int8)
        now = v.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            labels[begin[:n] + t] = now[:n]
            if t:
                now[:n] = back[begin[:n] + t, now[:n]]
        return [labels[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]

    def train(self, pages: list[list[list[int]]], labels: list[np.ndarray], rounds: int = ROUNDS, rate: float = 0.1, l2: float = 1e-3) -> None:
        """Maximum likelihood by forward-backward over all pages at once, padded to the longest."""
        numbers, first, ptr = self.flat(pages)
        y, size = np.concatenate(labels).astype(int), np.diff(ptr)
        n, steps = len(pages), int(size.max())
        at = np.minimum(ptr[:-1, None] + np.arange(steps), len(y) - 1)
        real = np.arange(steps) < size[:, None]
        block = np.repeat(np.arange(len(y)), np.diff(first))
        inner = np.ones(len(y), bool)
        inner[ptr[:-1]] = False
        seen_move = np.zeros((2, 2))
        np.add.at(seen_move, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        params = [self.emit, self.move, self.start]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for r in range(1, rounds + 1):
            e = self.scores(numbers, first)[at]
            fwd, bwd = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
            fwd[:, 0] = self.start + e[:, 0]
            for t in range(1, steps):
                x = np.logaddexp.reduce(fwd[:, t - 1, :, None] + self.move, axis=1) + e[:, t]
                fwd[:, t] = np.where(real[:, t, None], x, fwd[:, t - 1])
            total = np.logaddexp.reduce(fwd[:, -1], axis=1)
            for t in range(steps - 2, -1, -1):
                x = np.logaddexp.reduce(self.move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(real[:, t + 1, None], x, 0)
            p = np.exp(fwd + bwd - total[:, None, None])[real]
            pair = np.exp(fwd[:, :-1, :, None] + self.move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])
            g_move = seen_move - pair[real[:, 1:]].sum(0)
            miss = np.eye(2)[y] - p
            g_emit = np.zeros_like(self.emit)
            np.add.at(g_emit, numbers, miss[block])
            g_start = miss[ptr[:-1]].sum(0)
            for q, m, s, g in zip(params, mean, square, (g_emit, g_move, g_start), strict=True):
                g = g / len(y) - l2 * q
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                q += rate * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)


def labelled_pages(n: int, seed: int = 3) -> Iterator[tuple[str, list[int]]]:
    """Labelled pages (html, label of each leaf block): layouts as sites have them, in made-up words.

    Menus as lists, tables or bare links; content in article, main, section or plain div, with headings,
    lists, quotes and tables; advertisements, side bars, related links, comments and forms before, inside and after it.
    """
    r = np.random.default_rng(seed)
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.integers(1, 5)))

    def sentence(least: int = 5, most: int = 22) -> str:
        w = [word() for _ in range(r.integers(least, most))]
        if len(w) > 8 and r.random() < 0.6:
            w[len(w) // 2] += ","
        return w[0].capitalize() + " " + " ".join(w[1:]) + ("." if r.random() < 0.9 else "?")

    def paragraph() -> str:
        t = " ".join(sentence() for _ in range(r.integers(1, 7)))
        if r.random() < 0.1:
            t = sentence(1, 5)
        if r.random() < 0.15:
            t = t.replace(" ", f" <a href='/{word()}'>{word()}</a> ", 1)
        if r.random() < 0.15:
            t = f"<b>{t}" + ("</b>" if r.random() < 0.5 else "<br>")
        return t

    def phrase(most: int = 6) -> str:
        return " ".join(word() for _ in range(r.integers(1, most))).capitalize()

    for _ in range(n):
        out: list[tuple[str, int | None]] = []

        def put(markup: str, label: int | None = None, out=out) -> None:
            out.append((markup, label))

        def menu(put=put) -> None:
            kind, items = r.integers(3), int(r.integers(3, 9))
            if kind == 0:
                put("<ul>")
                for _ in range(items):
                    put(f"<li><a href='/{word()}'>{phrase(3)}</a></li>", 0)
                put("</ul>")
            elif kind == 1:
                put("<div>" + " | ".join(f"<a href='#'>{phrase(3)}</a>" for _ in range(items)) + "</div>", 0)
            else:
                put("<table><tr>")
                for _ in range(items):
                    put(f"<td><a href='#'>{phrase(3)}</a></td>", 0)
                put("</tr></table>")

        def noise(put=put) -> None:
            kind = r.integers(6)
            if kind == 0:
                put(f"<div class='{word()}'>{sentence(3, 12)}</div>", 0)
            elif kind == 1:
                put(f"<aside><p>{sentence(3, 14)}</p>", 0)
                put("</aside>")
            elif kind == 2:
                put(f"<div><h3>{phrase(4)}</h3>", 0)
                menu()
                put("</div>")
            elif kind == 3:
                put(f"<form><input name='q'><button>{phrase(2)}</button>", 0)
                put("</form>")
            elif kind == 4:
                put(f"<div><span>{r.integers(1, 2000)} {phrase(3)}</span></div>", 0)
            else:
                put(f"<aside><h4>{phrase(4)}</h4>", 0)
                put(f"<div>{sentence(3, 10)}</div>", 0)
                put("</aside>")

        put("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style></head><body><script>var a='<p>';</script>")
        if r.random() < 0.5:
            put(f"<header><div>{phrase(4)}</div>", 0)
            put("</header>")
        if r.random() < 0.85:
            put("<nav>" if (nav := r.random() < 0.6) else "<div>")
            menu()
            put("</nav>" if nav else "</div>")
        for _ in range(r.integers(0, 3)):
            noise()
        outer = r.choice(["<article>", "<main>", "<section>", "<div>", "<div><div>", "<main><article>", "<table><tr><td>"])
        put(str(outer))
        if r.random() < 0.85:
            put(f"<h1>{sentence(2, 10)}</h1>", 1)
        if r.random() < 0.3:
            put(f"<div>{phrase(3)} {r.integers(1, 28)}.{r.integers(1, 12)}.{r.integers(1990, 2025)}</div>", 0)
        closed = r.random() < 0.7
        for _ in range(r.integers(2, 16)):
            kind = r.random()
            if kind < 0.72:
                put(f"<p>{paragraph()}" + ("</p>" if closed else ""), 1)
            elif kind < 0.8:
                put(f"<h2>{phrase(7)}</h2>", 1)
            elif kind < 0.87:
                put("<ul>")
                for _ in range(r.integers(2, 5)):
                    put(f"<li>{sentence(3, 14)}</li>", 1)
                put("</ul>")
            elif kind < 0.91:
                put(f"<blockquote>{paragraph()}</blockquote>", 1)
            elif kind < 0.94:
                put(f"<pre>{phrase(9)} = {r.integers(99)}</pre>", 1)
            else:
                put(f"<div>{sentence(2, 8)}</div>", 0)
        put("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", str(outer)))))
        for _ in range(r.integers(0, 4)):
            noise()
        if r.random() < 0.85:
            tag = "footer" if r.random() < 0.7 else "div"
            put(f"<{tag}>" + r.choice(["&copy; ", "Copyright ", ""]) + f"{r.integers(2000, 2025)} {word()}.example &middot; {sentence(2, 9)}</{tag}>", 0)
        put("</body></html>")
        yield "".join(m for m, _ in out), [x for _, x in out if x is not None]


@lru_cache(1)
def trained(pages: int = PAGES, seed: int = 3) -> Field:
    """The field, trained on this many labelled pages."""
    data = [(features(blocks(h)), np.int64(y)) for h, y in labelled_pages(pages, seed)]
    data = [(f, y) for f, y in data if len(f) == len(y) and len(y)]
    field = Field()
    field.train([f for f, _ in data], [y for _, y in data])
    return field


def extract(pages: list[str | None], field: Field) -> list[tuple[int, int, str]]:
    """Number of blocks, of content blocks, and the content, of each page."""
    found = [blocks(p) for p in pages]
    labels = field.decode([features(b) for b in found])
    out = []
    for b, y in zip(found, labels, strict=True):
        kept = [x[1] for x, keep in zip(b, y, strict=True) if keep]
        out.append((len(b), len(kept), "\n\n".join(kept)))
    return out


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_blocks, n_content, text) of every page."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pages = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for i, j in W.chunks(pages):
                c = list(zip(*extract(pages[i:j], shared.value), strict=True))
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids[i:j]), "n_blocks": pa.array(c[0], pa.int32()), "n_content": pa.array(c[1], pa.int32()), "text": pa.array(c[2], pa.string())})

    return select_text(df, id_col, html_col).mapInArrow(run, "page_id long, n_blocks int, n_content int, text string")
