"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks (runs of text between block-level tags). A logistic regression gives each block log odds for
content from its text alone: number of words, share of link text, final punctuation, heading. It is fitted on at most
``SAMPLE`` pages, those with the lowest hash of the id: where they name their content by article or main, the blocks inside
are examples of content and the others of boilerplate; the ridge pulls to ``PRIOR``, which is all there is where no page
of the sample names its content.

The graph has a node for each block, whose odds become terminal capacities, and one for each marked element: boilerplate
(navigation, footers, sidebars, forms, comments, adverts and notices, by tag and by the words in class, id and role),
content (article and main), text (by its class), and, on pages that name their content, the page around it. These
hold to their terminal. Smoothness edges join neighbours in page order and next siblings, the stronger the nearer in the
tree, and each block with the marked elements it lies in. A maximum flow separates content from the rest: so an advert
of whole sentences goes with its element, and a short or linked paragraph stays with the text around it. Nodes whose
capacity exceeds all their edges are settled beforehand, which is exact and leaves little to the flow.

Tags are read by HTML's own states: a quote opens a value only right after the equals sign, and elsewhere belongs to a name
or an unquoted value; a quote that never closes is taken as part of a name, so that its tag ends at the next ">"; a
tag that never ends gives no text.

Scripts, styles, templates, graphics, form controls and comments of the markup never give text. Line breaks are white
space. Missing end tags follow the usual rules (a paragraph ends where a block starts, a list item at the next one, raw
text at its end tag or the end of the page).

Defined cases: null or empty html, and pages without content, give empty text and n_chars 0; repeated rows and null
ids are extracted apart; other columns are ignored; an empty table gives an empty result; pages of any length are
read whole.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: One attribute: its name, then perhaps a value in quotes, or up to white space.
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""
ATTRIBUTE = re.compile(rf"""(=?[^\s/>=]++|=)(?:\s*+=\s*+{_VALUE}?+)?+""")
_INSIDE = rf"""(?:[\s/]++|{ATTRIBUTE.pattern.replace("(=?", "(?:=?").replace("([^", "(?:[^")})*+"""
TOKEN = re.compile(rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)""", re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: HTML's block-level elements, elements without end tag and elements whose content isn't shown as text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav noframes ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("template svg math canvas object audio video select datalist button map applet".split())
#: What an opening tag ends, if it is open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table div section article main nav aside body td th menu".split())

BAD_TAGS = frozenset("nav footer aside form menu dialog head fieldset search".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments reply replies disqus cookie cookies"
    " consent gdpr notice notices alert footer footnav header masthead menu nav navbar navigation sidebar side rail related recommended recommendations share sharing social"
    " subscribe subscription newsletter signup login widget widgets popup modal overlay pagination pager toolbar copyright legal disclaimer skip search form teaser teasers"
    " trending popular tags tagcloud complementary contentinfo respond feedback".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
GOOD_WORDS = frozenset("article content entry main post story text body".split())

SAMPLE, RIDGE = 2000, 20.0
#: The regression's centre: intercept, link share (squared), words (25 are full), final punctuation, heading.
PRIOR = (-0.7, -4.5, 3.0, 0.4, 1.2)
#: Smoothness of neighbours: of one container, of one content element, others; and of next siblings.
NEAR, WITHIN, NEXT, SIBLING = 1.5, 1.0, 0.3, 0.8
#: Smoothness between a block and the marked elements around it.
BOILERPLATE, CONTENT, TEXT, OUTSIDE = 14.0, 5.0, 2.5, 7.0


#: What marks an element as text: a word in its class, or being a content element.
CLASS, INSIDE = 1, 2


class _Element:
    __slots__ = ("tag", "bad", "good", "number", "shut", "link", "marks")

    def __init__(self, tag, bad, good, number, shut, link, marks):
        self.tag, self.bad, self.good, self.number, self.shut, self.link = tag, bad, good, number, shut, link
        self.marks = marks  # the elements that made it boilerplate and content


def blocks(page: str) -> list[tuple[str, int, int, int, float, bool, tuple[int, int]]]:
    """(text, container, boilerplate, text or content, link share, heading, marking elements) of each block in order."""
    out: list = []
    stack = [_Element("", 0, 0, 0, False, False, (0, 0))]
    parts: list[str] = []
    linked, total, number, articles, at = 0, 0, 0, 0, 0
    heading = False

    def flush():
        nonlocal linked, total, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                for e in reversed(stack):
                    if e.tag in BLOCK or not e.tag:
                        top = e
                        break
                # the parent names the container, so that the paragraphs of one element are siblings
                container = next((e.number for e in reversed(stack) if e.tag in WALLS or not e.tag), 0)
                out.append((text, container, top.bad, top.good, linked / max(1, total), heading, top.marks))
            parts.clear()
        linked = total = 0
        heading = False

    def say(raw: str):
        nonlocal linked, total, heading
        top = stack[-1]
        if not raw or top.shut:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if not text.isspace():
            n = len(text.split())
            total += n
            if top.link:
                linked += n
            if len(stack) > 1 and any(e.tag[:1] == "h" and e.tag[1:].isdigit() for e in stack[-3:]):
                heading = True

    def close(to: int):
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        del stack[to:]

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in WALLS and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            parts.append(" ") if parts and tag not in BLOCK else flush() if tag in BLOCK else None
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or t in ENDS.get(tag, ()):
                    close(i)
                if t in WALLS and t not in ENDS.get(tag, ()):
                    break
            flush()
        if tag in VOID:
            continue
        top = stack[-1]
        number += 1
        words: set[str] = set()
        shut = top.shut or tag in HIDDEN
        if m[3] and tag not in ("html", "body"):
            for a in ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if "&" in value:
                    value = entities.unescape(value)
                if name in ("class", "id", "role"):
                    words.update(w.lower() for w in WORD.findall(value))
                elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    shut = True
        bad, good = top.bad, top.good
        if tag in BLOCK or tag in ("span", "a"):
            if tag in BAD_TAGS or (tag == "header" and good < INSIDE) or words & BAD_WORDS:
                # what only a class marks may still wrap the page's main element
                bad = 2 if tag in BAD_TAGS or words & COMMENT_WORDS else max(bad, 1)
            if tag == "main" or (tag == "article" and not words & BAD_WORDS):
                articles += tag == "article"
                if bad == 1 and (tag == "main" or articles == 1):
                    bad = 0
                if not bad:
                    good = INSIDE
            elif words & GOOD_WORDS and not bad:
                good = max(good, CLASS)
        marks = (top.marks[0] if bad == top.bad else number, top.marks[1] if good == top.good else number)
        stack.append(_Element(tag, bad, good, number, shut, top.link or tag == "a", marks))
    flush()
    return out


def features(rows: list) -> list[tuple]:
    """The regression's inputs of each block."""
    return [(1.0, links * links, min(1.0, (text.count(" ") + 1) / 25), float(text[-1] in ".!?…\"'”»"), float(heading)) for text, _, _, _, links, heading, _ in rows]


def named(rows: list) -> list[bool]:
    """Which blocks lie inside the content that the page names, and outside of boilerplate."""
    return [r[3] == INSIDE and not r[2] for r in rows]


def odds(rows: list, weights=PRIOR) -> list[float]:
    """Log odds of each block for content, by its text."""
    return [sum(w * v for w, v in zip(weights, x)) for x in features(rows)]


def graph(rows: list, z: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities of blocks and of marked elements, and the smoothness edges."""
    z, out, last, nodes = list(z), [], {}, {}
    region = any(named(rows))
    for i, r in enumerate(rows):
        if i:
            p = rows[i - 1]
            out.append((i - 1, i, NEAR if p[1] == r[1] else WITHIN if p[2:4] == r[2:4] and p[6] == r[6] and r[3] == INSIDE else NEXT))
        if last.get(r[1], i) < i - 1:
            out.append((last[r[1]], i, SIBLING))
        last[r[1]] = i
        for held, key, w in (
            (r[2], ("-", r[6][0]), -BOILERPLATE),
            (r[3] == INSIDE, ("+", r[6][1]), CONTENT),
            (r[3] == CLASS, ("+", r[6][1]), TEXT),
            (region and r[3] != INSIDE, ("-", -1), -OUTSIDE),
        ):
            if held:
                if key not in nodes:
                    nodes[key] = len(z)
                    z.append(0.0)
                z[nodes[key]] += w  # as much as all its edges, so it holds to its side
                out.append((i, nodes[key], abs(w)))
    return z, out


def fit(x: np.ndarray, y: np.ndarray, centre=PRIOR, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton steps, pulled to ``centre``."""
    w0 = np.array(centre)
    w = w0.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - w0))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def minimum_cut(z: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: minimises the odds given up plus the weights of edges cut."""
    n = len(z)
    z = list(z)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                z[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, z, near)):
            label[i] = side
    return label


def _flow(nodes: list[int], z: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by blocking flows on levels; True for nodes on the source's side."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        cap[source][i], cap[i][source] = max(z[i], 0.0), 0.0
        cap[i][sink], cap[sink][i] = max(-z[i], 0.0), 0.0
    while True:
        level, front = {source: 0}, [source]
        while front and sink not in level:
            new = []
            for i in front:
                for j, c in cap[i].items():
                    if c > 1e-9 and j not in level:
                        level[j] = level[i] + 1
                        new.append(j)
            front = new
        if sink not in level:
            return [i in level for i in nodes]
        order, at = {i: list(cap[i]) for i in level}, dict.fromkeys(level, 0)
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] += push
                back = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-9)
                del path[back + 1 :]
                continue
            while at[i] < len(order[i]):
                j = order[i][at[i]]
                if cap[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                at[i] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def main_text(page: str, weights=PRIOR) -> tuple[str, int, int]:
    """(text, number of blocks, blocks that the cut labels otherwise than their own odds) of a page."""
    rows = blocks(page)
    z = odds(rows, weights)
    keep = minimum_cut(*graph(rows, z))
    return "\n".join(r[0] for r, k in zip(rows, keep) if k), len(rows), sum(k != (v > 0) for k, v in zip(keep, z))


def fitted_weights(pages: DataFrame, sample: int = SAMPLE) -> list[float]:
    """The regression's weights from a bounded sample of pages that name their content."""

    def examples(batches):
        for pdf in batches:
            rows = [(list(x), y) for page in pdf["html"] for b in [blocks(page)] for ys in [named(b)] if any(ys) for x, y in zip(features(b), ys)]
            yield pd.DataFrame(rows, columns=["x", "y"])

    # which ids: a narrow top-k; only their pages are then read whole
    ids = pages.filter("page_id is not null").select("page_id").distinct().withColumn("h", F.xxhash64("page_id")).orderBy("h", "page_id").limit(sample)
    some = pages.filter("html is not null").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    got = some.select("html").mapInPandas(examples, "x array<double>, y boolean").groupBy("x", "y").count().orderBy("x", "y").collect()
    if not got:
        return list(PRIOR)
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    n = np.array([r["count"] for r in got])
    return fit(np.repeat(x, n, 0), np.repeat(y, n)).tolist()


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_moved (blocks that the cut labels otherwise than their own odds), one row
    per input row."""
    weights = fitted_weights(pages.select("page_id", "html"), sample)

    def run(batches):
        for pdf in batches:
            got = [main_text(h or "", weights) for h in pdf["html"]]
            text, n, moved = zip(*got) if got else ((), (), ())
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": list(text), "n_chars": list(map(len, text)), "n_blocks": list(n), "n_moved": list(moved)})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_moved long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
