"""Main text of HTML pages: boosted trees over features of DOM nodes, decoded along the tree.

Each element has a log-odds of being a part of the article, from its subtree's density of text and links, its attribute
tokens, depth, ancestors and siblings. Decoding picks the best labelling in which nothing under a dropped
element is kept. The trees learn from generated pages of many layouts, since no table labels pages.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import arrow_rows, text_parts
from .dom import SILENT, Page

TRAIN_PAGES = 700
TRAIN_SEED = 11
#: Elements that are measured and scored at once.
STEP_NODES = 20_000

# Tokens of class, id and role attributes, and elements, that tell of a part's purpose.
TOKEN_KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager topbar skip toc",
    "head": "header masthead banner logo top branding",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more complementary tags tagcloud archive",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion promoted dfp taboola outbrain affiliate",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter paywall message disclaimer warning toast banner",
    "form": "form search login signup register contact feedback poll input",
    "talk": "comment comments reply replies discussion disqus respond thread commentlist feedback review reviews",
    "share": "share sharing social facebook twitter like follow buttons",
    "body": "article content main post entry story text body prose copy articlebody blog hentry markdown page",
}
TAG_KINDS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset label legend", "article": "article", "main": "main",
    "section": "section", "div": "div", "p": "p pre blockquote", "list": "ul ol dl", "item": "li dt dd", "link": "a", "heading": "h1 h2 h3 h4 h5 h6",
    "inline": "b i em strong span u small sup sub code q cite mark font abbr time", "table": "table tbody thead tfoot tr td th caption", "figure": "figure figcaption img picture",
}
_TOKEN_OF = {}
for _k, (_kind, _names) in enumerate(TOKEN_KINDS.items()):
    for _name in _names.split():
        _TOKEN_OF.setdefault(_name, []).append(_k)
_TAG_OF = {name: k for k, names in enumerate(TAG_KINDS.values()) for name in names.split()}
_BAD_TAGS = frozenset("nav menu footer aside form fieldset".split())
N_TOKENS, N_TAGS = len(TOKEN_KINDS), len(TAG_KINDS)


def measure(page: Page) -> np.ndarray:
    """A row of features for each element."""
    n = len(page.tag)
    parent = page.parent
    own, words, marks = [0] * n, [0] * n, [0] * n
    before, seen = [0] * n, 0
    first = [-1] * n
    for node, text, _ in page.texts:
        size = len(text.strip())
        if first[node] < 0:
            first[node] = seen
        own[node] += size
        words[node] += text.count(" ") + (size > 0)
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        seen += size
    depth, link = [0] * n, [False] * n
    up = np.zeros((n, N_TOKENS + 1))
    mine = np.zeros((n, N_TOKENS))
    tag = np.zeros((n, N_TAGS))
    children, place = [0] * n, [0] * n
    same = [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        link[i] = link[p] or page.tag[i] == "a"
        for t in page.tokens[i]:
            for k in _TOKEN_OF.get(t, ()):
                mine[i, k] = 1
        k = _TAG_OF.get(page.tag[i])
        if k is not None:
            tag[i, k] = 1
        up[i, :N_TOKENS] = np.maximum(up[p, :N_TOKENS], mine[i])
        up[i, N_TOKENS] = max(up[p, N_TOKENS], page.tag[i] in _BAD_TAGS)
        place[i] = children[p]
        children[p] += 1
    by_parent: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        key = (parent[i], page.tag[i])
        by_parent[key] = by_parent.get(key, 0) + 1
    for i in range(1, n):
        same[i] = by_parent[parent[i], page.tag[i]]
    total, linked, tags, paragraphs = list(own), [o if k else 0 for o, k in zip(own, link, strict=True)], [1] * n, [0] * n
    all_words, all_marks = list(words), list(marks)
    start = list(first)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        linked[p] += linked[i]
        tags[p] += tags[i]
        all_words[p] += all_words[i]
        all_marks[p] += all_marks[i]
        paragraphs[p] += paragraphs[i] + (page.tag[i] == "p")
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    whole = max(1, seen)
    a = np.array([own, total, linked, tags, paragraphs, all_words, all_marks, depth, children, place, same, start], np.float64).T
    at = np.array(parent)
    above = np.maximum(at, 0)
    text, here = a[:, 1], np.maximum(a[:, 1], 1)
    shape = np.stack([
        np.log1p(a[:, 0]), np.log1p(text), text / whole, a[:, 2] / here, text / a[:, 3], a[:, 4], np.log1p(a[:, 5]), text / np.maximum(a[:, 5], 1),
        100 * a[:, 6] / here, a[:, 7], a[:, 8], a[:, 9], a[:, 10], np.maximum(a[:, 11], 0) / whole, text / np.maximum(text[above], 1), a[above, 2] / here[above],
        np.log1p(text[above]), a[above, 8], a[above, 4], a[:, 9] / np.maximum(a[above, 8], 1),
    ], 1)
    return np.concatenate([shape, mine, up, tag, tag[above]], 1)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which elements stay. A dropped element's whole subtree is dropped; among such labellings the most likely one.

    An element weighs by its own text: with log-odds z and weight w, keeping it is worth w * log p, dropping it w * log (1 - p).
    """
    n = len(page.tag)
    own = [0] * n
    for node, text, _ in page.texts:
        own[node] += len(text.strip())
    weight = 0.25 + np.log1p(np.array(own))
    keep, drop = -np.logaddexp(0, -odds) * weight, -np.logaddexp(0, odds) * weight
    keep, drop = keep.tolist(), drop.tolist()
    best = [0.0] * n  # of the subtrees below
    gone = [0.0] * n
    choice = [True] * n
    for i in range(n - 1, 0, -1):
        inside, outside = keep[i] + best[i], drop[i] + gone[i]
        silent = page.tag[i] in SILENT or page.hidden[i]
        choice[i] = not silent and inside > outside
        best[page.parent[i]] += outside if silent else max(inside, outside)
        gone[page.parent[i]] += outside
    for i in range(1, n):
        choice[i] = choice[i] and choice[page.parent[i]]
    return choice


def kept_text(page: Page, keep: list[bool]) -> str:
    """Text of the kept elements in page order: white space is one space, and so is a block's edge."""
    parts: list[str] = []
    edge = False
    for node, text, broken in page.texts:
        edge = edge or broken
        if keep[node]:
            if edge:
                parts.append(" ")
                edge = False
            parts.append(text)
    return " ".join("".join(parts).split())


# --- generated pages --------------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ne ra tu sel van dor ist en ge pla qui bar os um tri fer co al men sta ri po".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def _prose(r: random.Random, low: int = 1, high: int = 8) -> str:
    out = " ".join(_sentence(r) for _ in range(r.randint(low, high)))
    if r.random() < 0.25:
        w = out.split(" ")
        k = r.randrange(len(w))
        w[k] = r.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<code>{}</code>"]).format(w[k])
        out = " ".join(w)
    if r.random() < 0.12:  # marks after each word
        out = " ".join(w + r.choice(["%%%", "***", "###", "&amp;"]) for w in out.split(" ") if "<" not in w)
    return out


def _paragraph(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.62:
        return f"<p>{_prose(r)}</p>"
    if kind < 0.74:
        return f"<p><b>{_prose(r)}<br>"  # ended by what follows
    if kind < 0.80:
        return f"<h{(h := r.randint(2, 4))}>{_sentence(r, 2, 7)}</h{h}>"
    if kind < 0.85:
        return "<ul>" + "".join(f"<li>{_prose(r, 1, 2)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
    if kind < 0.89:
        return f"<blockquote>{_prose(r, 1, 3)}</blockquote>"
    if kind < 0.92:
        return f"<p>{_sentence(r, 1, 2)}</p>"
    if kind < 0.95:
        return "<table>" + "".join("<tr>" + "".join(f"<td>{_word(r)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
    return f"<div>{_prose(r)}</div>"


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{" ".join(_word(r) for _ in range(r.randint(1, 3)))}</a></li>' for i in range(n))


def _noise(r: random.Random, kind: str, semantic: bool) -> str:
    """A part that isn't the article."""
    names = [x for x in TOKEN_KINDS[{"menu": "menu", "head": "head", "foot": "foot", "side": "side", "ad": "ad", "note": "note", "form": "form", "talk": "talk", "share": "share"}[kind]].split()]
    name = r.choice(names) + r.choice(["", "-box", "_1", " clearfix"])
    attr = r.choice([f'class="{name}"', f'id="{name}"', f'class="x {name}"'])
    tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div") if semantic else r.choice(["div", "div", "section"])
    if tag != "div" and r.random() < 0.6:
        attr = ""
    if kind == "menu":
        inner = f"<ul>{_links(r, r.randint(2, 10))}</ul>" if r.random() < 0.8 else " | ".join(f"<a href='/{i}'>{_word(r)}</a>" for i in range(r.randint(2, 8)))
    elif kind == "head":
        inner = f"<h1>{_sentence(r, 1, 4)}</h1><p>{_sentence(r)}</p>" if r.random() < 0.5 else f"<a href='/'>{_word(r)}</a> <span>{_sentence(r, 2, 5)}</span>"
    elif kind == "foot":
        inner = r.choice([f"&copy; {_word(r)}.com &middot; {_sentence(r)}", f"<p>&copy; 2020 {_sentence(r)}</p><p>{_prose(r, 1, 2)}</p>", f"<ul>{_links(r, 4)}</ul><small>{_sentence(r)}</small>", _prose(r, 1, 3)])
    elif kind == "side":
        inner = f"<h3>{_sentence(r, 1, 3)}</h3>" + r.choice([f"<ul>{_links(r, r.randint(3, 8))}</ul>", f"<p>{_prose(r, 1, 3)}</p>", "".join(f"<div><a href='/{i}'>{_sentence(r)}</a><p>{_sentence(r)}</p></div>" for i in range(3))])
    elif kind == "ad":
        inner = r.choice([_sentence(r), _prose(r, 1, 3), f"<a href='/buy'>{_sentence(r)}</a>", f"<p>{_prose(r, 1, 2)}</p>"])
    elif kind == "note":
        inner = f"<p>{_prose(r, 1, 3)}</p>" + r.choice(["", "<button>OK</button>", "<a href='#'>ok</a>"])
    elif kind == "form":
        inner = f"<label>{_sentence(r, 1, 3)}</label><input type='text'><p>{_sentence(r)}</p><button>Go</button>"
    elif kind == "talk":
        item = lambda: f"<div class='{r.choice(['comment', 'reply', 'c-item', 'entry'])}'><b>{_word(r)}</b><p>{_prose(r, 1, 4)}</p></div>"
        inner = f"<h3>{_sentence(r, 1, 3)}</h3>" + "".join(item() for _ in range(r.randint(1, 6)))
    else:
        inner = "".join(f"<a href='/{i}'>{_word(r)}</a> " for i in range(r.randint(2, 5)))
    return f'<{tag} data-y="0" {attr}>{inner}</{tag}>'


def generated_page(r: random.Random) -> str:
    """A page whose elements carry data-y: 1 for the article, 0 for the rest; an element without one is as its parent."""
    semantic = r.random() < 0.6
    body = [_paragraph(r) for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8, 12, 20]))]
    if r.random() < 0.85:
        body.insert(0, f"<h1>{_sentence(r, 2, 12)}</h1>")
    if not body:
        body = [f"<p>{_prose(r)}</p>"]
    for kind in ("ad", "share", "side", "note", "form"):
        if len(body) > 2 and r.random() < 0.15:
            body.insert(r.randint(1, len(body)), _noise(r, kind, semantic and kind != "ad"))
    name = r.choice(TOKEN_KINDS["body"].split()) + r.choice(["", "-body", "_main", " col-8"])
    tag = r.choice(["article", "article", "main", "section"]) if semantic else "div"
    attr = "" if tag in ("article", "main") and r.random() < 0.6 else r.choice([f'class="{name}"', f'id="{name}"', f'class="{name}"', ""])
    article = f'<{tag} data-y="1" {attr}>{"".join(body)}</{tag}>'
    if r.random() < 0.3:
        article = f'<div class="{r.choice(["wrapper", "container", "row", "page", "site", "inner"])}">{article}</div>'
    above = [k for k, p in (("note", 0.25), ("head", 0.45), ("menu", 0.8), ("ad", 0.5), ("form", 0.2), ("side", 0.15)) if r.random() < p]
    below = [k for k, p in (("share", 0.2), ("talk", 0.35), ("side", 0.4), ("ad", 0.25), ("form", 0.15), ("note", 0.1), ("menu", 0.1), ("foot", 0.85)) if r.random() < p]
    parts = [_noise(r, k, semantic) for k in above] + [article] + [_noise(r, k, semantic) for k in below]
    if r.random() < 0.3:
        i = next(i for i, p in enumerate(parts) if 'data-y="1"' in p)
        parts[max(0, i - 1) : i + 2] = [f'<div class="{r.choice(["layout", "container", "grid"])}">' + "".join(parts[max(0, i - 1) : i + 2]) + "</div>"]
    end = r.choice(["</body></html>", "</body></html>", ""])
    return f'<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body data-y="0">' + r.choice(["", "<!-- x -->"]).join(parts) + end


def marks_of(page: Page) -> np.ndarray:
    """1 where an element or its nearest marked ancestor has data-y 1; an unmarked frame around an article counts as one of it."""
    y = np.zeros(len(page.tag))
    for i in range(1, len(y)):
        y[i] = y[page.parent[i]] if page.mark[i] is None else float(page.mark[i])
    for i in range(len(y) - 1, 0, -1):
        if y[i] and not page.mark[page.parent[i]] == "0":
            y[page.parent[i]] = 1
        elif y[i]:  # the body holds the article, and must not be dropped
            y[page.parent[i]] = 1
    return y


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> boost.BoostedTrees:
    """Trees from generated pages, the same for the same arguments."""
    r = random.Random(seed)
    x, y, w = [], [], []
    for _ in range(pages):
        page = Page(generated_page(r))
        m = measure(page)
        seen = np.array([t not in SILENT for t in page.tag])
        seen[0] = False
        x.append(m[seen])
        y.append(marks_of(page)[seen])
        w.append(np.log1p(np.exp(m[seen, 1]) - 1) / 4 + 0.25)
    return boost.fit(np.concatenate(x), np.concatenate(y), np.concatenate(w))


def extract_pages(html: Iterable[str | None], model: boost.BoostedTrees) -> Iterator[str]:
    """The main text of each page; empty for null, for pages without elements or text, and if nothing stays."""
    pages: list[Page] = []
    held = 0

    def flush() -> Iterator[str]:
        features = [measure(p) for p in pages]
        odds = model.log_odds(np.concatenate(features))
        at = 0
        for p in pages:
            yield kept_text(p, decode(p, odds[at : at + len(p.tag)]))
            at += len(p.tag)

    for x in html:
        pages.append(Page(x or ""))
        held += len(pages[-1].tag)
        if held >= STEP_NODES:
            yield from flush()
            pages.clear()
            held = 0
    if pages:
        yield from flush()


def extract_text(pages: DataFrame, model: boost.BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    The whole html is read, however long or deep; null and empty give empty text. Text outside any element belongs to the document and
    stays. Repeated rows and null ids each give their row; empty input gives no rows; other columns aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw in text_parts(batch.column(2)):
                text = list(extract_pages((x.decode("utf-8", "replace") for x in raw), shared.value))
                yield arrow_rows({"page_id": batch.column(0).slice(a, b - a), "url": batch.column(1).slice(a, b - a), "text": text, "n_chars": [len(t) for t in text]}, schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
