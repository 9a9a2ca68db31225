"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page becomes its leaf blocks in order; each has the tags and the class and id words of its ancestors,
and features of its text (length, share of link text, marks). The field gives every block one of two
labels, neighbours influencing each other; Viterbi finds the best sequence, and the blocks labelled main
are the text. The field is fitted on labelled pages that `labelled_pages` lays out in many ways.

Scripts, styles, templates, comments of the markup and the head are no blocks. Character references are
decoded, white space inside a block is one blank, <br> is white space. Defined results: null and empty
pages, and pages without a main block, have empty text; unclosed and stray tags end where the next block
makes them end; repeated pages have equal texts; pages are read whole, whatever their length.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Laid-out pages the field is fitted on.
LABELLED_PAGES = 700
STEPS, RATE, DECAY = 220, 0.1, 3e-4

# How HTML elements behave (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = frozenset("article aside body dl fieldset figure footer form header html main menu nav ol section table td th ul div blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|"
    r"<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.DOTALL)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[tuple[str, tuple[str, ...]], ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: every stretch of text that no block element interrupts."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0
    ends: dict[str, re.Pattern] = {}

    def close() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(tuple(x for x in stack if x[0] in BLOCK), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, _ in stack[at:])
        del stack[at:]

    page = page or ""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK and stack[i][0] in SCOPE:
                    break
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if tag in RAW:
            if attrs.endswith("/"):
                continue
            pattern = ends.get(tag) or ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE))
            found = pattern.search(page, at)
            at = found.end() if found else size
            continue
        if tag in BLOCK:
            close()
            _imply_ends(stack, tag, pop_to)
        elif tag == "br":
            parts.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        names = tuple(w for found in _NAMES.findall(attrs) for w in _WORD.findall("".join(found).lower())) if "=" in attrs and tag in BLOCK else ()
        stack.append((tag, names))
        links += tag == "a"
    close()
    return out


def _imply_ends(stack: list, tag: str, pop_to) -> None:
    """A block ends an open paragraph; items, cells and rows end their kind."""
    ended = ENDS.get(tag, set()) | {"p"} | ({"h1", "h2", "h3", "h4", "h5", "h6"} if tag in ("p", "div", "ul", "ol", "table", "section") else set())
    lowest = None
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0]
        if name in ended:
            lowest = i
        elif name in SCOPE:
            break
    if lowest is not None:
        pop_to(lowest)


def path_features(path: tuple) -> set[str]:
    out = {"bias"}
    for i, (tag, names) in enumerate(path):
        out.add(f"in {tag}")
        for name in names:
            out.add(f"named {name}")
        if i == len(path) - 1:
            out.add(f"own {tag}")
    return out


def in_article(block: Block) -> bool:
    return any(tag in ("article", "main") for tag, _ in block.path)


def text_features(block: Block, place: int, total: int, articled: bool) -> tuple[str, ...]:
    """``articled``: the page has an article element somewhere."""
    n = len(block.text)
    share = block.linked / n
    return (
        "beside the article" if articled and not in_article(block) else "in the article" if articled else "no article",
        f"length {min(9, n.bit_length())}", "links all" if share > 0.8 else "links some" if share > 0.2 else "links none",
        "ends like a sentence" if block.text[-1] in ".!?…。" else "ends open", "first" if place == 0 else "last" if place == total - 1 else "inner",
        "copyright" if "©" in block.text[:40] or "(c)" in block.text[:40].lower() else "no copyright",
    )


class Field:
    """Weights of features for the label main (other is zero), and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps
        self._paths: dict[tuple, float] = {}

    def emission(self, block: Block, place: int, total: int, articled: bool) -> float:
        base = self._paths.get(block.path)
        if base is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            base = self._paths[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        get = self.weights.get
        return base + sum(get(f, 0.0) for f in text_features(block, place, total, articled))

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi over the two labels."""
        (oo, om), (mo, mm) = self.steps.tolist()
        back, n, articled = [], len(found), any(map(in_article, found))
        other, main = 0.0, 0.0
        for i, block in enumerate(found):
            score = self.emission(block, i, n, articled)
            if i == 0:
                other, main = 0.0, score
                continue
            from_other, from_main = (other + oo, main + mo), (other + om, main + mm)
            back.append((from_other[1] > from_other[0], from_main[1] >= from_main[0]))
            other, main = max(from_other), max(from_main) + score
        labels = [main > other] if n else []
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def fit(pages: list[tuple[list[Block], list[bool]]]) -> Field:
    """Maximise the conditional likelihood by Adam, with all pages side by side."""
    names: dict[str, int] = {}
    rows, cols, longest, total = [], [], max(len(b) for b, _ in pages), 0
    for found, _ in pages:
        articled = any(map(in_article, found))
        for i, block in enumerate(found):
            for f in path_features(block.path) | set(text_features(block, i, len(found), articled)):
                rows.append(total), cols.append(names.setdefault(f, len(names)))
            total += 1
    x = np.zeros((total, len(names)), np.float32)
    x[rows, cols] = 1
    page = np.repeat(np.arange(len(pages)), [len(b) for b, _ in pages])
    place = np.concatenate([np.arange(len(b)) for b, _ in pages])
    truth = np.array([y for _, labels in pages for y in labels], int)
    size = np.array([len(b) for b, _ in pages])
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(t), np.zeros_like(t)]]
    same = page[1:] == page[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:-1][same], truth[1:][same]), 1)
    for step in range(1, STEPS + 1):
        e = np.zeros((len(pages), longest, 2))
        e[page, place, 1] = x @ w.astype(np.float32)
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for i in range(1, longest):
            ahead[:, i] = e[:, i] + _logsum(ahead[:, i - 1, :, None] + t, 1)
        for i in range(longest - 2, -1, -1):
            nxt = _logsum(t + (e[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where((i + 1 < size)[:, None], nxt, 0)
        z = _logsum(ahead[np.arange(len(pages)), size - 1], 1)
        p = np.exp(ahead[page, place] + behind[page, place] - z[page][:, None])
        first, second = np.flatnonzero(same), np.flatnonzero(same) + 1
        pair = np.exp(ahead[page[first], place[first]][:, :, None] + t + (e[page[second], place[second]] + behind[page[second], place[second]])[:, None, :] - z[page[first]][:, None, None])
        grads = [x.T @ (p[:, 1] - truth).astype(np.float32) / len(pages) + DECAY * w, (pair.sum(0) - seen) / len(pages) + DECAY * t]
        for target, grad, moment in ((w, grads[0], moments[0]), (t, grads[1], moments[1])):
            moment[0] = 0.9 * moment[0] + 0.1 * grad
            moment[1] = 0.99 * moment[1] + 0.01 * grad * grad
            target -= RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return Field({name: float(w[k]) for name, k in names.items()}, t)


# Words by which page builders name the parts of a page (fixed values).
NOT_MAIN = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topnav toc pagination pager tabs links",
    "header": "header masthead topbar logo branding site head banner hero",
    "footer": "footer foot bottom colophon copyright legal credits",
    "aside": "sidebar side aside widget related recommended trending popular archive tags rail",
    "notice": "cookie cookies notice consent gdpr alert warning popup modal overlay privacy paywall disclaimer",
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo promotion promoted banner teaser",
    "form": "form search login signup subscribe newsletter contact poll",
    "comments": "comment comments reply replies discussion disqus responses respond thread reader feedback",
    "share": "share sharing social follow twitter facebook author bio byline meta",
}
#: Marks the main blocks of laid-out pages until they are labelled; a private-use character.
MAIN_MARK = "\ue000"
MAIN = "content article post entry story main body text page primary single column news blog container"


def labelled_pages(count: int = LABELLED_PAGES, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Pages laid out in many ways, with the label of every block: main blocks carry a mark in their text."""
    return [_labelled(_Layout(random.Random(seed * 100_003 + i)).page()) for i in range(count)]


def _labelled(page: str) -> tuple[list[Block], list[bool]]:
    found = blocks(page)
    labels = [b.text.startswith(MAIN_MARK) for b in found]
    for b in found:
        b.text = b.text.replace(MAIN_MARK, "").strip() or "x"
    return found, labels


class _Layout:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(("th", "er", "on", "an", "de", "la", "in", "es", "que", "ch", "ti", "é")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(out)

    def sentence(self, low: int = 1, high: int = 40) -> str:
        return self.words(low, high).capitalize() + self.r.choice((".", ".", ".", "!", "?", ""))

    def named(self, kind: str, tags: str) -> tuple[str, str]:
        tag = self.r.choice(tags.split())
        plain = tag in ("nav", "header", "footer", "aside", "form")
        if plain and self.r.random() < 0.5:
            return f"<{tag}>", f"</{tag}>"
        words = self.r.choice(NOT_MAIN[kind].split())
        if self.r.random() < 0.3:
            words += self.r.choice((" ", "-", "_")) + self.r.choice("box block wrap inner left right top item list area".split())
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{words}">', f"</{tag}>"

    def links(self) -> str:
        r = self.r
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8))]
        form = r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if form < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def prose(self) -> str:
        return self.r.choice(("{}", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>")).format(self.sentence(1, 25))

    def part(self, kind: str) -> str:
        r = self.r
        tags = {"nav": "nav nav div ul", "header": "header header div", "footer": "footer footer div", "aside": "aside aside div section",
                "notice": "div div section p", "ad": "div div aside p section", "form": "form form div", "comments": "section div div ol", "share": "div div ul p"}[kind]
        start, end = self.named(kind, tags)
        if kind == "nav":
            inner = self.links()
        elif kind == "header":
            inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 5)}</h2><p>{self.sentence(2, 8)}</p>", self.links(), f"<a href='/'>{self.words(1, 3)}</a>", self.prose()))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.words(1, 2)} &middot; {self.sentence(2, 14)}", f"<p>&copy; 20{r.randint(10, 29)} {self.words(1, 4)}</p>", self.links(), self.prose()))
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.sentence(2, 12)}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            some = "".join(r.choice(("<div class=comment><b>{}</b><p>{}</p></div>", "<li>{}: {}</li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<p>{}</p><p>{}</p>")).format(self.words(1, 2), self.sentence(2, 30)) for _ in range(r.randint(1, 5)))
            inner = (f"<h3>{self.words(1, 2)}</h3>" if r.random() < 0.5 else "") + some
        elif kind in ("aside", "share"):
            inner = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.5 else "") + r.choice((self.links(), self.prose(), self.prose() + self.prose()))
        else:
            inner = "".join(self.prose() for _ in range(r.randint(1, 2)))
        if start.startswith("<p"):  # a paragraph holds no other block
            inner = self.sentence(1, 25)
        elif kind == "nav" and start.startswith("<ul"):
            inner = "".join(f"<li><a href=/>{self.words(1, 3)}</a></li>" for _ in range(r.randint(2, 8)))
        return start + inner + end

    def main(self) -> str:
        r, out, mark = self.r, [], MAIN_MARK
        if r.random() < 0.8:
            out.append(f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{mark}{self.words(1, 12)}</{h}>")
        for _ in range(r.randint(0 if out else 1, 14)):
            form = r.random()
            text = mark + " ".join(self.sentence(1, 30) for _ in range(r.randint(1, 4)))
            if form < 0.62:
                out.append(f"<p>{text}" + ("</p>" if r.random() < 0.8 else ""))
            elif form < 0.7:
                out.append(f"<p><b>{text}<br>" if r.random() < 0.5 else f"<p>{text[:-1]}<br>{self.sentence(1, 9)}</p>")
            elif form < 0.73:
                out.append(f"<hr>{text}<hr>")
            elif form < 0.77:
                out.append(f"<h{(n := r.randint(2, 4))}>{mark}{self.words(1, 8)}</h{n}>")
            elif form < 0.84:
                out.append("<ul>" + "".join(f"<li>{mark}{self.sentence(1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif form < 0.89:
                out.append(f"<blockquote><p>{text}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{text}</blockquote>")
            elif form < 0.92:
                out.append(f"<pre>{text}</pre>")
            elif form < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{mark}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f"<figure><img src=x.png><figcaption>{mark}{self.sentence(2, 9)}</figcaption></figure>")
            if r.random() < 0.2:
                out.append(self.part(r.choice(("ad", "aside", "share", "notice", "form"))))
        if r.random() < 0.15:
            out.append(self.part(r.choice(("comments", "share", "ad", "footer", "aside"))))
        inner = "".join(out)
        form = r.random()
        if form < 0.55:
            name = f' class="{r.choice(MAIN.split())}"' if r.random() < 0.3 else ""
            inner = f"<article{name}>{inner}</article>"
        elif form < 0.7:
            inner = f"<main>{inner}</main>"
        else:
            inner = f'<div {r.choice(("class", "id"))}="{r.choice(MAIN.split())}">{inner}</div>'
        if r.random() < 0.2:
            inner = f"<main>{inner}</main>" if r.random() < 0.5 else f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{inner}</div>'
        return inner

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "ad", "aside", "form") if r.random() < 0.4]
        after = [k for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(self.part(k) for k in before) + self.main() + "".join(self.part(k) for k in after)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}" + r.choice(("</body></html>", ""))


def extract(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, main in zip(found, field.decode(found), strict=True) if main)


def main_text(pages: DataFrame, field: Field | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    fitted = field or fit(labelled_pages())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [extract(x, fitted) for x in part.html]
            yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_column).cast("string").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema[id_column].dataType))
