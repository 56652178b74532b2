"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. A block has its number of words and its link
density, those of its neighbours, and what its containers say. Tags such as ``nav`` or ``footer`` are
strong evidence. Class, id and role names are weak: a container is suspected by a part of one of
its names (``site-footer``) unless another part says the opposite (``entry-content comments-open``), ``html``,
``body``, ``main`` and ``article`` never are, and a suspected container comes with the share of the
page's words it holds and its link density, as counter-evidence: furniture is rarely most of a page. The
tree also learns whether a block lies in an article, and whether it lies outside of one on a page that
has some. A decision tree (Spark ML) trained on a small labelled table tells main text from the rest.
It is applied as an expression over the array of blocks, so pages are never exploded or shuffled.

Character references are decoded, white space in a block becomes one space, and the chosen
blocks are joined in page order by two newlines. Scripts, styles, comments and the like are
never text. A tag that never ends is dropped with what follows it. Null, empty and tag-free
pages: null and empty give the empty text, a page without any tag is one block. Repeated
rows give the same text each. Columns other than the kept ones are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template svg math iframe object textarea title select".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
NEUTRAL_TAGS = frozenset("html body main article".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr header legal login masthead menu modal nav navbar "
    "navigation newsletter notice pager pagination popup promo recommended related replies reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(.*?)>?\Z", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+")

FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after",
    "strong", "suspected", "comment", "share", "container_density", "main", "outside", "header", "heading",
)
_SHARES = ("share", "container_density")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Container:
    """An open element: what it says about its text, and how much text and links it holds."""

    __slots__ = ("name", "strong", "suspected", "comment", "main", "header", "heading", "words", "linked")

    def __init__(self, name: str, rest: str):
        parts = set(_PARTS.findall(" ".join(_NAMES.findall(rest)).lower())) if rest else set()
        hidden = bool(rest) and _HIDDEN.search(rest) is not None
        self.name = name
        self.main = name in ("article", "main") or bool(parts & MAIN_WORDS)
        self.comment = bool(parts & COMMENT_WORDS) and not parts & MAIN_WORDS
        self.suspected = bool(parts & FURNITURE_WORDS) and not parts & MAIN_WORDS and name not in NEUTRAL_TAGS
        self.strong = name in FURNITURE_TAGS or hidden
        self.header = name == "header"
        self.heading = name in _HEADINGS
        self.words = self.linked = 0


BLOCK = ("text", "words", "linked", *FEATURES[6:])


def blocks(page: str) -> list[tuple]:
    """What ``BLOCK`` names of every block with text."""
    out: list[tuple] = []
    pieces: list[str] = []
    linked = 0
    link_from = -1  # number of pieces when the open link began
    stack: list[_Container] = []

    def count_link() -> None:
        nonlocal linked, link_from
        if link_from >= 0:
            linked += len(html.unescape("".join(pieces[link_from:])).split())
            link_from = -1

    def close() -> None:
        nonlocal linked, link_from
        in_link = link_from >= 0
        count_link()
        words = html.unescape("".join(pieces)).split()
        if words:
            for container in stack:
                container.words += len(words)
                container.linked += min(linked, len(words))
            out.append((" ".join(words), len(words), min(linked, len(words)), tuple(stack)))
        pieces.clear()
        linked, link_from = 0, 0 if in_link else -1

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            pieces.append(page[at:])
            break
        pieces.append(page[at : tag.start()])
        at = tag.end()
        name, end, rest = tag["name"], tag["end"], tag["rest"]
        if name is None:
            loose = _LOOSE.match(tag[0]) if tag[0].endswith(">") else None
            if loose is None or tag[0].startswith("<!--"):
                continue
            end, name, rest = loose.groups()
        name = name.lower()
        if name in SKIPPED_TAGS and not end:
            if rest.endswith("/"):
                continue
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            if name in BLOCK_TAGS:
                close()
        elif name == "a":
            count_link()
            if not end:
                link_from = len(pieces)
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK_TAGS:
            close()
            if name in VOID_TAGS:
                continue
            if not end:
                if stack and stack[-1].name == "p":  # a paragraph ends where a block begins
                    stack.pop()
                if not rest.endswith("/"):
                    stack.append(_Container(name, rest))
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
    close()
    return _judged(out)


def _judged(found: list[tuple]) -> list[tuple]:
    """Blocks with what their containers say, once all text has been counted."""
    total = max(1, sum(words for _, words, _, _ in found))
    some_main = any(x.main for *_, stack in found for x in stack)
    out = []
    for text, words, linked, stack in found:
        suspects = [x for x in stack if x.suspected or x.comment]
        widest = suspects[0] if suspects else None
        main = any(x.main for x in stack)
        out.append((
            text, words, linked, int(any(x.strong for x in stack)), int(bool(suspects)),
            int(any(x.comment for x in stack)), widest.words / total if widest else 0.0,
            widest.linked / max(1, widest.words) if widest else 0.0, int(main), int(some_main and not main),
            int(any(x.header for x in stack) and not main), int(any(x.heading for x in stack)),
        ))
    return out


def labelled_pages(seed: int = 5, pages: int = 400) -> list[tuple[str, list[int]]]:
    """Pages in common layouts with a label for each block (1: main text).

    The layouts vary by rule: the article in a semantic tag, a named container, a container whose
    name looks like furniture, or none; menus, headers, notices, adverts, side columns, forms,
    reader comments, teasers and footers around it, marked by tags, by names or not at all.
    """
    draw = random.Random(seed)

    def prose(low: int, high: int) -> str:
        return " ".join(["word"] * draw.randint(low, high)) + "."

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{" ".join(["link"] * draw.randint(1, 4))}</a></li>' for _ in range(n))

    def paragraph() -> str:
        kind = draw.random()
        if kind < 0.08:
            return f'<p><a href="#">{prose(1, 12)}</a></p>'
        text = prose(1, 12) if kind < 0.45 else prose(12, 120)
        return f'<p>{text} <a href="#">{prose(1, 4)}</a></p>' if draw.random() < 0.2 else f"<p>{text}</p>"

    out = []
    for i in range(pages):
        layout = ("tag", "name", "wrapped", "bare", "tag", "name")[i % 6]
        marked = layout != "bare"
        parts: list[tuple[str, list[int]]] = []

        def furniture(chance: float, tag: str, names: str, inner: str, n: int, parts=parts, marked=marked) -> None:
            if draw.random() < chance:
                by_tag = marked and draw.random() < 0.5
                name = draw.choice(names.split()) if marked and not by_tag else ""
                parts.append((f'<{tag if by_tag else "div"} class="{name}">{inner}</{tag if by_tag else "div"}>', [0] * n))

        n = draw.randint(3, 9)
        furniture(0.8, "nav", "menu site-nav navbar top-menu", f"<ul>{links(n)}</ul>", n)
        if marked and draw.random() < 0.5:
            parts.append((f"<header><p>{prose(1, 8)}</p></header>", [0]))
        if marked and draw.random() < 0.5:
            parts.append((f'<div class="{draw.choice(["cookie-notice", "banner", "ad-box"])}"><p>{prose(4, 60)}</p></div>', [0]))
        body, labels = [], []
        if draw.random() < 0.9:
            body.append(f"<h1>{prose(2, 12)}</h1>")
            labels.append(1)
        for _ in range(draw.randint(1, 9)):
            body.append(paragraph())
            labels.append(1)
            if draw.random() < 0.12 and marked:
                body.append(f'<div class="{draw.choice(["ad", "advert", "share-bar", "newsletter"])}">{prose(3, 40)}</div>')
                labels.append(0)
        if marked and draw.random() < 0.3:
            n = draw.randint(1, 12)
            name = draw.choice(["comments", "comment-list", "replies"])
            body.append(f'<section class="{name}">{"".join(f"<p>{prose(3, 80)}</p>" for _ in range(n))}</section>')
            labels += [0] * n
        opening, tag = {
            "tag": (draw.choice(["article", "main"]),) * 2,
            "name": (f'div class="{draw.choice(["content", "post", "entry-content comments-open", "story form-article"])}"', "div"),
            "wrapped": (f'div class="{draw.choice(["social-science", "legal-news", "has-sidebar", "header-page"])}"', "div"),
            "bare": ("div", "div"),
        }[layout]
        parts.append((f"<{opening}>{''.join(body)}</{tag}>", labels))
        if marked:
            furniture(0.4, "aside", "sidebar side-widget promo", f"<h3>{prose(1, 3)}</h3><p>{prose(4, 40)}</p>", 2)
            furniture(0.3, "form", "newsletter signup search-box", f"<p>{prose(2, 10)}</p>", 1)
        n = draw.randint(2, 6)
        furniture(0.5, "aside", "related recommended", f"<ul>{links(n)}</ul>", n)
        if layout in ("tag", "name") and draw.random() < 0.3:
            # text of a page outside its article that no container marks
            parts.append((f"<div><p>{prose(1, 6)}</p></div>", [0]))
        if marked:
            furniture(0.7, "footer", "site-footer copyright legal-notice", f"<p>{prose(2, 12)}</p>", 1)
        page = "".join(p for p, _ in parts)
        if draw.random() < 0.3:
            page = f'<body class="{draw.choice(["home has-sidebar", "page-with-comments", "single-post"])}">{page}</body>'
        out.append((page, [x for _, own in parts for x in own]))
    return out


def _neighbours(found: list[tuple]) -> list[tuple[float, ...]]:
    """The features of each block of a page, in the order of ``FEATURES``."""
    sizes = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    return [
        tuple(map(float, (*sizes[i + 1], *sizes[i], *sizes[i + 2], *found[i][3:]))) for i in range(len(found))
    ]


def train(spark: SparkSession, pages: list[tuple[str, list[int]]] | None = None, depth: int = 8):
    """A decision tree as nested tuples ``(feature, threshold, left, right)`` or a label."""
    rows = []
    for page, labels in pages or labelled_pages():
        found = _neighbours(blocks(page))
        rows += [(*x, float(y)) for x, y in zip(found, labels, strict=True)]
    table = spark.createDataFrame(rows, [*FEATURES, "label"]).coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=3, seed=1).fit(vectors)

    def walk(node):
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._java_obj.rootNode())


def _decide(tree, features: list[Column]) -> Column:
    if isinstance(tree, int):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(features[feature] <= threshold, _decide(left, features)).otherwise(_decide(right, features))


def parsed(pages: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """The kept columns and ``blocks`` of every page."""
    source = pages.select(*(F.col(c) for c in keep), F.col(text).alias("__html"))
    schema = source.select(*keep).schema.add("blocks", _block_type())
    kind = pa.list_(pa.struct(
        [("text", pa.string()), *((n, pa.float64() if n in _SHARES else pa.int32()) for n in BLOCK[1:])]
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [
                    [dict(zip(BLOCK, b, strict=True)) for b in blocks(x or "")]
                    for x in part.column("__html").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(found, kind)], [*keep, "blocks"]
                )

    return source.mapInArrow(run, schema)


def _block_type():
    block = StructType().add("text", StringType())
    for name in BLOCK[1:]:
        block = block.add(name, DoubleType() if name in _SHARES else IntegerType())
    return ArrayType(block)


def extract(
    pages: DataFrame, tree=None, keep: tuple[str, ...] = ("page_id", "url"), text: str = "html"
) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` of every page."""
    tree = train(pages.sparkSession) if tree is None else tree
    found = parsed(pages, keep, text)

    def size(i: Column) -> Column:
        return F.when(i >= 0, F.coalesce(F.get("blocks", i)["words"], F.lit(0))).otherwise(F.lit(0))

    def density(i: Column) -> Column:
        block = F.get("blocks", i)
        return F.when(i >= 0, F.coalesce(block["linked"] / block["words"], F.lit(0.0))).otherwise(F.lit(0.0))

    def chosen(block: Column, i: Column) -> Column:
        features = [size(i), density(i), size(i - 1), density(i - 1), size(i + 1), density(i + 1),
                    *(block[name] for name in FEATURES[6:])]
        return F.when(_decide(tree, features) == 1, block["text"])

    body = F.array_join(F.array_compact(F.transform("blocks", chosen)), "\n\n")
    return found.select(*keep, body.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
