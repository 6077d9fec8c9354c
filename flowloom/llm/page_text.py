"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and words. Words score positive where words are usually
content, tags score negative, and words in places that are usually not content score negative
too; one scan over the sequence finds the contiguous region with the largest sum. The region is
widened to whole blocks, and the elements inside it that are no content themselves (scripts,
forms, adverts, comments, ...) give no text.

The weights come from labelled pages: a page that marks its content with an article or main
element labels each of its own tags and words as inside or outside. They are counted over all
such pages by the element around them, leaving out elements that are no content wherever they
stand. The counts are one small row per kind, of a fixed list of elements. A weight is the log of
how much likelier the kind is inside than outside; tags stay negative. Inside a marked element the
words are positive and tags cost next to nothing, outside of it words are negative.

Text is decoded once, white space inside a block becomes one blank, blocks are joined by line
feeds. Defined results: a null or empty page, and a page without any positive word, gives an
empty text. Rows are read one by one, repeated rows alike. An empty table gives an empty table.
Unclosed and crossing tags are taken as browsers do in the plain cases: a block ends an open
paragraph, an end tag closes what was opened after its start.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.batches import map_batches, pieces
from pyspark.sql.types import LongType, StringType, StructField, StructType

TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">]|['"](?=[^'"]*>))*)(?:>|$)"""
    r"""|(?P<text>[^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|itemprop|type|hidden|aria-hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Elements of the page format, fixed by it.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style noscript template title textarea iframe svg math object".split())
BLOCKS = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no main text, wherever they stand.
LEFT_OUT = RAW_TEXT | set("nav footer aside form button select option dialog head menu audio video canvas".split())
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split()
)
#: Words in class names and ids of elements that are no main text.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors "
    "promo promotion promoted cookie cookies consent gdpr notice notices notification disclaimer popup modal "
    "overlay newsletter subscribe subscription signup signin login register sidebar sidebars sidenav aside rail "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar share sharing "
    "social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "responses discussion feedback search widget widgets copyright pagination pager skip".split()
)
#: Words that say an element holds the main text although another word speaks against it.
CONTENT_MARKS = set("article content main post entry story".split())
AMID, FRAME = 1, 2
FRAME_NAMES = set("nav footer aside head menu".split())
FRAME_MARKS = set("header footer foot nav navbar navigation menu menus sidebar sidebars sidenav masthead".split())
#: Bounds of the weights of words and tags, and the weight of what no labelled page shows.
WORD_WEIGHT, TAG_WEIGHT = (0.5, 4.0), (-0.5, -0.05)
AWAY_WEIGHT = -2.0
#: Weight of words in links where no labelled page shows any outside its content.
LINK_WEIGHT = -1.0
SMOOTHING = 5.0


def class_words(value: str) -> set[str]:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    return {w for w in re.split(r"[^A-Za-z]+", spaced.lower()) if w}


class Item:
    """An open element."""

    __slots__ = ("name", "left_out", "marked", "link")

    def __init__(self, name: str, left_out: int, marked: bool, link: bool):
        self.name, self.left_out, self.marked, self.link = name, left_out, marked, link


def left_out_as(name: str, rest: str, in_marked: bool) -> int:
    """0: content; AMID: no content but stands amid it; FRAME: the frame of the page."""
    if name in LEFT_OUT:
        return FRAME if name in FRAME_NAMES else AMID
    if name in ("html", "body", "main", "article"):
        return 0
    if name == "header" and not in_marked:
        return FRAME
    if not rest or rest.isspace():
        return 0
    names: set[str] = set()
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return AMID
        if key == "role" and value.lower() in ROLES:
            return AMID
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return AMID
        if key in ("class", "id"):
            names |= class_words(value)
    bad = names & MARKS or ("header" in names and not in_marked)
    if not bad or names & CONTENT_MARKS:
        return 0
    return FRAME if names & FRAME_MARKS else AMID


def is_marked(name: str, rest: str) -> bool:
    return name in ("article", "main") or bool(
        rest and re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articlebody\b""", rest, re.I)
    )


def tokens(page: str) -> Iterator[tuple[str, str, int, bool, str]]:
    """(kind, name, how it is left out, marked inside, text): tags, and texts with the element around them.

    ``kind`` is tag or text. A tag that starts or ends a block has the text of a line feed.
    """
    stack: list[Item] = []
    done, size = 0, len(page)

    def top() -> Item | None:
        return stack[-1] if stack else None

    def around() -> str:
        for item in reversed(stack):
            if item.name in BLOCKS:
                return item.name
        return "body"

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name == name:
                del stack[i:]
                return

    while done < size:
        m = TOKEN.match(page, done)
        done = m.end()
        if m["text"] is not None:
            item = top()
            yield (
                "text",
                "a" if item and item.link else around(),
                item.left_out if item else 0,
                bool(item and item.marked),
                m["text"],
            )
            continue
        if m["name"] is None:
            continue
        name, rest = m["name"].lower(), m["rest"]
        block = "\n" if name in BLOCKS else ""
        if m["end"]:
            item = top()
            state = (item.left_out if item else 0, bool(item and item.marked))
            yield "tag", name, *state, block
            close(name)
            continue
        if name in RAW_TEXT and not rest.endswith("/"):
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, done)
            inner = stop.start() if stop else size
            end = page.find(">", inner)
            done = size if not stop or end < 0 else end + 1
            item = top()
            yield "tag", name, max(AMID, item.left_out if item else 0), bool(item and item.marked), ""
            continue
        if block and name != "br":
            # A block ends a paragraph, an entry ends the one before.
            if stack and any(x.name == "p" for x in stack[-4:]):
                close("p")
            if name in ("li", "tr", "td", "th", "dt", "dd") and stack and stack[-1].name == name:
                stack.pop()
        item = top()
        marked = bool(item and item.marked) or is_marked(name, rest)
        left_out = max(item.left_out if item else 0, left_out_as(name, rest, bool(item and item.marked)))
        yield "tag", name, left_out, marked, block
        if name not in VOID and not rest.endswith("/"):
            stack.append(Item(name, left_out, marked, name == "a" or bool(item and item.link)))


def place(left_out: int, marked: bool, has_mark: bool) -> str:
    """Where a token stands; what is left out amid the content is no reason to end it there."""
    if left_out:
        return "skipped" if marked or left_out == AMID else "outside"
    return "inside" if marked else "outside" if has_mark else "unmarked"


def kinds(found: list) -> Iterator[tuple[str, str, bool, int]]:
    """(word or tag, name, inside, count) of a labelled page."""
    for kind, name, left_out, marked, text in found:
        if left_out:
            continue
        known = name if name in BLOCKS or name in VOID or name in LEFT_OUT or name == "a" else "other"
        if kind == "tag":
            yield "tag", known, marked, 1
        elif not text.isspace():
            yield "word", known, marked, len(text.split())


def learn(pages: DataFrame, column: str = "html") -> dict[tuple[str, str], float]:
    """Weight of each kind of word and tag, from all pages that mark their content.

    What comes to the driver is one row per kind; names outside the fixed lists count as one.
    """
    schema = pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for piece in pieces(batch, column):
                for page in piece.column(0).to_pylist():
                    found = list(tokens(page)) if page else []
                    if any(t[3] for t in found):
                        for kind, name, inside, n in kinds(found):
                            counts[kind, name, inside] += n
        rows = [(*k, n) for k, n in counts.items()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    counted = pages.select(column).mapInArrow(run, "kind string, name string, inside boolean, n long")
    rows = counted.groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    seen = {(r["kind"], r["name"], r["inside"]): r["n"] for r in rows}
    weights = {}
    for kind, name in {(k, n) for k, n, _ in seen}:
        inside, outside = (seen.get((kind, name, i), 0) + SMOOTHING for i in (True, False))
        odds = math.log(inside / outside)
        if kind == "tag":
            weights[kind, name] = min(max(odds, TAG_WEIGHT[0]), TAG_WEIGHT[1])
        else:
            weights[kind, name] = max(odds, AWAY_WEIGHT) if odds < 0 else min(max(odds, WORD_WEIGHT[0]), WORD_WEIGHT[1])
    return weights


def score(kind: str, name: str, where: str, weights: dict[tuple[str, str], float]) -> float:
    """Score of one word or tag."""
    known = name if (kind, name) in weights else "other"
    if kind == "tag":
        near = where in ("inside", "skipped")
        return TAG_WEIGHT[1] if near else weights.get((kind, known), TAG_WEIGHT[1])
    if where == "skipped":
        return 0.0
    if where == "outside":
        return AWAY_WEIGHT
    default = LINK_WEIGHT if name == "a" else WORD_WEIGHT[0]
    weight = weights.get((kind, name), default)
    return max(weight, WORD_WEIGHT[0]) if where == "inside" else weight


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest positive sum; (0, 0) if there is none."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def extract(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The main text of a page."""
    found = list(tokens(page)) if page else []
    has_mark = any(t[3] for t in found)
    scores = []
    for kind, name, left_out, marked, text in found:
        where = place(left_out, marked, has_mark)
        if kind == "tag":
            scores.append(score(kind, name, where, weights))
        else:
            count = 0 if text.isspace() else len(html.unescape(text).split())
            scores.append(count * score("word", name, where, weights))
    first, last = best_region(scores)
    if first == last:
        return ""
    while first > 0 and not (found[first][0] == "tag" and found[first][4]):
        first -= 1
    while last < len(found) and not (found[last][0] == "tag" and found[last][4]):
        last += 1
    blocks, held = [], []
    for kind, name, left_out, marked, text in found[first:last]:
        if kind == "tag":
            if text and held:
                blocks.append("".join(held))
                held = []
        elif place(left_out, marked, has_mark) in ("inside", "unmarked"):
            held.append(text)
    blocks.append("".join(held))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


EXTRACTED = StructType(
    [
        StructField("page_id", LongType()),
        StructField("url", StringType()),
        StructField("text", StringType()),
    ]
)


def main_text(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    model = learn(pages) if weights is None else weights

    def run(batch):
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url").to_pylist(),
            "text": [extract(p, model) for p in batch.column("html").to_pylist()],
        }

    return map_batches(pages, "html", run, EXTRACTED)
