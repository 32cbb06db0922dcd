"""Main text of web pages by a tree-structured graphical model over the elements of a page.

Every element has a hidden label, content or not. A parent and a child are tied by how often a child of that tag is content below a
parent that is or is not; an element's own evidence is its class and id words, size, share of link text and sentence ends. One
pass of messages up the tree and one down give each element's marginal; text of elements that are more likely content than not is
the main text. Everything is counted on labelled pages.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatspark.llm.common import column, small_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul "
    "script style noscript template iframe textarea #text".split()
)
#: A start tag ends the open elements on the left side of these, unless one of the right side stands between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = BLOCK - set("td th tr tbody thead tfoot caption option button".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_GAP = re.compile(r"\s+")
_STOP = re.compile(r"[.!?…。]")
#: Labelled pages are drawn from the table up to this many, of up to this many characters each.
SAMPLE = 300
LONGEST_LABELLED = 100_000
SMOOTH = 0.5
#: How a made fragment says that what stands outside its elements is main text.
MAIN_ROOT = "<!--data-main-->"
#: Names by which a piece inside an article is labelled as not belonging to it.
APART = set(
    "ad ads advert advertisement banner breadcrumb comment comments cookie disclaimer feedback footer form header login menu nav navigation "
    "newsletter notice pagination popup promo related reply share sharing sidebar social sponsor subscribe toolbar widget".split()
)


class Page(NamedTuple):
    """Elements in page order (tag, parent, name words) and events: ``(element, raw text)``, or ``(-1, "")`` where a block ends."""

    tags: list
    parents: list
    names: list
    events: list


def parse(html: str) -> Page:
    """Elements and texts of a page; unclosed, crossed and stray tags are mended as browsers do in the common cases.

    Text outside all elements stands in an implied element ``#text`` for each run of it, which is a block and has a label of its own.
    """
    tags, parents, names, events = ["#root"], [-1], [()], []
    stack, at, size = [0], 0, len(html)

    def say(text: str) -> None:
        if len(stack) == 1 and text.strip():
            tags.append("#text")
            parents.append(0)
            names.append(())
            events.append((-1, ""))
            stack.append(len(tags) - 1)
        events.append((stack[-1], text))

    def close_to(depth: int) -> None:
        if any(tags[i] in BLOCK for i in stack[depth:]):
            events.append((-1, ""))
        del stack[depth:]

    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    close_to(depth)
                    break
            continue
        if tag in _CLOSES_P:
            if len(stack) > 1 and tags[stack[1]] == "#text":
                close_to(1)
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == "p":
                    close_to(depth)
                    break
                if tags[stack[depth]] in BLOCK:
                    break
        if tag in ENDED_BY:
            ends, fences = ENDED_BY[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] in ends:
                    close_to(depth)
                    break
                if tags[stack[depth]] in fences:
                    break
        if tag == "br":
            events.append((stack[-1], " "))
        if tag in VOID:
            continue
        if tag in BLOCK:
            events.append((-1, ""))
        attributes = found[3] or ""
        said = _NAMES.findall(attributes) if attributes else ()
        tags.append(tag)
        parents.append(stack[-1])
        names.append(tuple(sorted({w.lower() for x in said for w in _WORD.findall(x)})))
        if attributes.endswith("/"):
            continue
        stack.append(len(tags) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            if tag in ("title", "textarea"):
                events.append((stack[-1], html[at:stop]))
            at = stop
    return Page(tags, parents, names, events)


def evidence(page: Page) -> list[list[str]]:
    """Features of each element apart from its tag."""
    n = len(page.tags)
    size, linked, stops = [0] * n, [0] * n, [0] * n
    for i, text in page.events:
        if i >= 0:
            size[i] += len(text)
            stops[i] += len(_STOP.findall(text))
    for i in range(n):
        if page.tags[i] == "a":
            linked[i] = size[i]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        size[p] += size[i]
        linked[p] += size[i] if page.tags[i] == "a" else linked[i]
        stops[p] += stops[i]
    out = []
    for i in range(n):
        share = linked[i] / size[i] if size[i] else 0
        if not i:  # the root is the body of a page that has none
            own = ["root=whole" if {"html", "body"} & set(page.tags) else "root=bare"]
            out.append(own)
            continue
        own = [f"size={min(size[i].bit_length(), 13)}", f"links={0 if not linked[i] else 1 + int(share * 3.999)}", f"stops={min(stops[i].bit_length(), 5)}"]
        out.append(own + [f"name={w}" for w in page.names[i]])
    return out


class Model(NamedTuple):
    """Log odds of features, and of being content for a child by tag and by the parent's label."""

    weight: dict
    below: dict
    other: tuple


def train(labelled: list[tuple[Page, list[bool]]]) -> Model:
    """Smoothed counts over labelled pages: features by label, and a child's label by its tag and the parent's label."""
    seen = [defaultdict(float), defaultdict(float)]
    total = [0, 0]
    ties: dict = defaultdict(lambda: [[SMOOTH, SMOOTH], [SMOOTH, SMOOTH]])
    overall = [[1.0, 1.0], [1.0, 1.0]]
    for page, labels in labelled:
        for i, features in enumerate(evidence(page)):
            y = int(labels[i])
            total[y] += 1
            for f in features:
                seen[y][f] += 1
            if i:
                p = int(labels[page.parents[i]])
                ties[page.tags[i]][p][y] += 1
                overall[p][y] += 1
    weight = {f: math.log((seen[1][f] + SMOOTH) / (total[1] + 2 * SMOOTH)) - math.log((seen[0][f] + SMOOTH) / (total[0] + 2 * SMOOTH)) for f in {*seen[0], *seen[1]}}
    odds = lambda t: tuple((t[p][0] / sum(t[p]), t[p][1] / sum(t[p])) for p in (0, 1))
    return Model(weight, {tag: odds(t) for tag, t in ties.items()}, odds(overall))


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of content for each element, exact on the tree: messages up, then down."""
    n = len(page.tags)
    own, up = [], [(1.0, 1.0)] * n
    for features in evidence(page):
        w = max(-30.0, min(30.0, sum(model.weight.get(f, 0.0) for f in features)))
        own.append((1 / (1 + math.exp(w)), 1 / (1 + math.exp(-w))))
    ties = [model.below.get(t, model.other) for t in page.tags]
    below = list(own)  # own evidence and all messages from children
    for i in range(n - 1, 0, -1):
        a, b = below[i]
        t = ties[i]
        m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
        s = m0 + m1
        up[i] = (m0 / s, m1 / s)
        p = page.parents[i]
        x, y = below[p][0] * up[i][0], below[p][1] * up[i][1]
        s = x + y
        below[p] = (x / s, y / s)
    belief = [below[0]] + [(0.0, 1.0)] * (n - 1)
    for i in range(1, n):
        p = belief[page.parents[i]]
        # The parent's belief without this child's message, passed down the tie.
        q0, q1 = p[0] / up[i][0], p[1] / up[i][1]
        t = ties[i]
        x, y = below[i][0] * (q0 * t[0][0] + q1 * t[1][0]), below[i][1] * (q0 * t[0][1] + q1 * t[1][1])
        s = x + y
        belief[i] = (x / s, y / s)
    return [b[1] for b in belief]


def main_text(html: str | None, model: Model) -> str:
    """Blocks of content text, white space made single blanks, joined by line ends; empty for null and where nothing is content."""
    if not html:
        return ""
    page = parse(html)
    content = [m > 0.5 for m in marginals(page, model)]
    blocks, held = [], []
    for i, text in [*page.events, (-1, "")]:
        if i >= 0:
            if content[i]:
                held.append(text)
        elif held:
            block = _GAP.sub(" ", unescape("".join(held))).strip()
            held = []
            if block:
                blocks.append(block)
    return "\n".join(blocks)


def article_labels(page: Page) -> list[bool] | None:
    """Labels of a page whose main text is marked: all inside its article elements but the pieces named as apart from it; never the root."""
    if "article" not in page.tags:
        return None
    out = [False]
    for tag, parent, names in zip(page.tags[1:], page.parents[1:], page.names[1:]):
        apart = tag in RAW or tag in APART or tag == "aside" or not APART.isdisjoint(names)
        out.append((tag == "article" or out[parent]) and not apart)
    return out


def layout_pages(n: int = 400, seed: int = 0) -> list[str]:
    """Labelled pages of many layouts; elements of the main text have the attribute ``data-main``."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choices("aeilnorstu", k=rng.randint(2, 8))) for _ in range(rng.randint(a, b)))
    sentences = lambda a, b: " ".join(words(4, 14).capitalize() + rng.choice("...?!") for _ in range(rng.randint(a, b)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def apart() -> str:
        name = rng.choice(sorted(APART))
        inner = rng.choice([links(), sentences(1, 3), f"<p>{sentences(1, 4)}</p>", f"<p>{words(2, 6)}</p>", f'<a href="/y">{words(1, 4)}</a>'])
        kind = rng.random()
        if kind < 0.25:
            tag = rng.choice(["nav", "aside", "header", "footer"])
            return f"<{tag}>{inner}</{tag}>"
        if kind < 0.35:
            return f"<form><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>"
        if kind < 0.55:
            person = lambda: f'<div class="comment"><b>{words(1, 2)}</b><p>{sentences(1, 5)}</p></div>'
            return f'<{"section" if kind < 0.45 else "div"} class="comments">' + "".join(person() for _ in range(rng.randint(1, 4))) + ("</section>" if kind < 0.45 else "</div>")
        return f'<div {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-box", " wide"])}">{inner}</div>'

    def main() -> str:
        m = " data-main"
        part = lambda: rng.choice([
            f"<p{m}>{sentences(1, 9)}</p>", f"<p{m}>{sentences(1, 6)}</p>", f"<p{m}><b{m}>{words(1, 5)}</b> {sentences(1, 4)}</p>",
            f'<p{m}>{sentences(1, 3)} <a{m} href="/z">{words(1, 3)}</a> {sentences(1, 2)}</p>', f"<h2{m}>{words(2, 6)}</h2>",
            f"<ul{m}><li{m}>{sentences(1, 1)}</li><li{m}>{words(2, 6)}</li></ul>", f"<blockquote{m}><p{m}>{sentences(1, 3)}</p></blockquote>",
            f"<table{m}><tr{m}><td{m}>{words(1, 3)}</td><td{m}>{words(1, 3)}</td></tr></table>", f"<pre{m}>{words(3, 9)}</pre>",
        ])
        body = "".join(part() + (apart() if rng.random() < 0.12 else "") for _ in range(rng.randint(1, 9)))
        head = f"<h1{m}>{words(3, 9)}</h1>" if rng.random() < 0.8 else ""
        left, right = rng.choice([("article", "article"), ("article", "article"), ("main", "main"), ('div class="content"', "div"), ('div class="post entry"', "div"), ('div id="story"', "div"), ('section class="article body"', "section")])
        return f"<{left}{m}>{head}{body}</{right}>", head + body

    out = []
    for _ in range(n):
        middle, bare = main()
        if rng.random() < 0.15:  # a fragment: its parts stand where a body would be, some of them as text without an element
            out.append(MAIN_ROOT + (sentences(1, 6) if rng.random() < 0.5 else "") + bare + (sentences(1, 4) if rng.random() < 0.3 else ""))
            continue
        if rng.random() < 0.4:
            middle = f'<div class="{rng.choice(["wrap", "container", "page", "row"])}">{middle}{apart() if rng.random() < 0.5 else ""}</div>'
        before, after = ("".join(apart() for _ in range(rng.randint(0, 3))) for _ in range(2))
        head = f"<head><meta charset=utf-8><title>{words(3, 8)}</title><style>p{{}}</style><script>x('</p>')</script></head>"
        out.append(f"<html>{head}<body><nav>{links()}</nav>{before}{middle}{after}<footer>{sentences(1, 2)}</footer></body></html>")
    return out


def marked_labels(html: str) -> tuple[Page, list[bool]]:
    """A page with ``data-main`` attributes, and the labels that they give; text outside elements has the root's label."""
    marks = []
    for found in _TAG.finditer(re.sub(r"(?s)(<script>).*?(</script>)", r"\1\2", html)):
        if found[2] and not found[1] and found[2].lower() not in VOID:
            marks.append("data-main" in found[3])
    page, main_root, marks = parse(html), html.startswith(MAIN_ROOT), iter(marks)
    return page, [main_root if tag in ("#root", "#text") else next(marks) for tag in page.tags]


def labelled_pages(pages: DataFrame, sample: int = SAMPLE, longest: int = LONGEST_LABELLED, id_col: str = "page_id", html_col: str = "html") -> list[tuple[Page, list[bool]]]:
    """The layouts of ``layout_pages``, and pages of the table that mark their article: those with the smallest hash of the id, up
    to ``sample`` pages of up to ``longest`` characters."""
    html = column(html_col)
    picked = pages.where((F.length(html) <= longest) & F.contains(F.lower(html), F.lit("<article"))).select(column(id_col).alias("i"), html.alias("h"))
    # Ids are picked without their pages, so that no task sends more than a few numbers.
    ids = [r.i for r in picked.where("i IS NOT NULL").select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(sample).collect()]
    rows = picked.where(F.col("i").isin(ids)).groupBy("i").agg(F.min("h").alias("h")).orderBy("i").collect()
    out = [marked_labels(x) for x in layout_pages()]
    for row in rows:
        page = parse(row.h)
        out.append((page, article_labels(page) or [False] * len(page.tags)))
    return out


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; columns of these names are replaced.

    Every row stays. Null and empty pages, and those without content, have an empty text. Pages are parsed whole, one at a time.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    shown = [c for c in kept if c != html_col] if html_col in kept else kept
    rows = pages.select(*(column(c) for c in shown), column(html_col).alias("__html"))
    schema = rows.drop("__html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, schema)
