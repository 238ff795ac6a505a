"""Main-text extraction with wrappers inferred as union-free regular expressions.

A page becomes a tree of block elements. Within a page, and then over the pages of a host, aligned
streams of siblings are merged: elements that match are merged inside, those that one side lacks become optional groups,
neighbours (or short tandem runs) of the same make become repeated groups, and text becomes a slot.
The result, the host's wrapper, is a regular expression without unions. Every page is then matched to its
wrapper, and for each slot it is counted on how many of the host's pages each text stands there (pages with the same
body count once). A text that stands in its slot on half of the pages with that slot (in an article or main element, on
nine tenths), and on ``PAGES`` at least, is the host's template; headings of an article never are.
Main text is what else stands in the article, or outside menus, notices, adverts and the like. Words of class, id and
role are only a hint for that: they do not count on body, main, article and the article's headings, and where a
page has no other text, what varies over the host's pages inside marked elements and forms is its main text. A host
of fewer than ``PAGES`` different pages has no counts; there, element names and hints decide alone.

Scale: a page first reduces to its own pattern, patterns are made distinct by host with map-side
combining, merged in ``SALTS`` slices a host and then across slices, so a host with a third of all
pages is never gathered. Wrappers meet the pages in a join salted the same way; texts are counted as
fingerprints, in Spark aggregations over (host, slot, text).

Edge cases: a null or empty html, or one without main text, gives an empty text; text without tags is
main text; unclosed and misnested tags are closed as browsers do; elements nest to any depth; character references follow HTML5; a
null url belongs to a host without name; repeated rows keep their rows; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Generator, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

SALTS = 32
#: Different pages of a host that must show a slot before its texts are told to be constant or to vary.
PAGES = 3
#: Share of the pages with a slot on which a text is the host's template: outside and inside an article or main element.
SHARE, SHARE_INSIDE = 0.5, 0.9

#: Element names of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object canvas audio video".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements never part of the main text, and words of class, id and role that mark such parts.
BOILERPLATE = set("head nav footer aside form menu button select option optgroup label dialog fieldset legend datalist output".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Which open element a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hints never remove.
WHOLE = set("html body main article".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPES = set("ul ol dl table article section main body div".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Element:
    __slots__ = ("children", "inline", "name", "sign")

    def __init__(self, name: str, sign: str, inline: bool = False):
        self.name, self.sign, self.inline = name, sign, inline
        self.children: list[Element | str | None] = []


def signature(name: str, attributes: str) -> str:
    """The element's name, its boilerplate marks, and ``!`` if it is hidden."""
    marks, hidden = set(), ""
    for m in _ATTRIBUTE.finditer(attributes or ""):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            marks |= MARKS.intersection(re.split(r"[^a-z]+", value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = "!"
    return ".".join([name, *sorted(marks)]) + hidden


def parse(text: str) -> Element:
    """The tree of a page; a block's text stands in its children, None marks a line break."""
    root = Element("", "")
    stack = [root]
    opened: Counter[str] = Counter()

    def cut(i: int) -> None:
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]

    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[7]:
            stack[-1].children.append(entities.unescape(m[7]))
        elif not name:
            continue
        elif m[1] or m[4]:
            for i in () if opened[name] < 1 else range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    cut(i)
                    break
                if stack[i].name in ("td", "th", "table") and name != "table" and name not in ("tr", "tbody", "thead"):
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif name in VOID:
            stack[-1].children.append(None)
        else:
            inline = name in INLINE
            if not inline:
                closed = CLOSES.get(name, set()) | {"p"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in closed:
                        cut(i)
                    elif not stack[i].inline and (name not in CLOSES or stack[i].name in SCOPES):
                        break
            element = Element(name, signature(name, m[3] or m[6]), inline)
            stack[-1].children.append(element)
            stack.append(element)
            opened[name] += 1
    return root


Node = list  # [signature, quantifier ("1", "?", "+", "*"), children]; a text slot is ["#", quantifier, []]


def _loosest(*quantifiers: str) -> str:
    many, none = any(q in "+*" for q in quantifiers), any(q in "?*" for q in quantifiers)
    return {(False, False): "1", (False, True): "?", (True, False): "+", (True, True): "*"}[many, none]


def _flat(element: Element) -> Iterator[Element | str | None]:
    """Children with inline elements dissolved, hidden or marked ones kept."""
    stack = [iter(element.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, Element) and c.inline and c.sign == c.name:
                stack.append(iter(c.children))
                break
            yield c
        else:
            stack.pop()


def _finish(call: Generator):
    """The result of a function that yields the calls it makes; pages of any depth need no deeper Python stack."""
    stack, got = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(got))
            got = None
        except StopIteration as done:
            stack.pop()
            got = done.value
    return got


def _merge(a: Node, b: Node):
    return [a[0], _loosest(a[1], b[1]), (yield _align(a[2], b[2]))]


def _fold(nodes: list[Node]):
    """Tandem repeats of up to four siblings become one repeated group."""
    for width in range(1, 5):
        out: list[Node] = []
        for n in nodes:
            out.append(n)
            while len(out) >= 2 * width and [x[0] for x in out[-width:]] == [x[0] for x in out[-2 * width : -width]]:
                again = []
                for x, y in zip(out[-2 * width : -width], out[-width:], strict=True):
                    both = yield _merge(x, y)
                    again.append([both[0], _loosest(both[1], "+"), both[2]])
                out[-2 * width :] = again
        nodes = out
    return nodes


def _align(a: list[Node], b: list[Node]):
    if not a and not b:
        return []
    out: list[Node] = []
    left, right = [x[0] for x in a], [x[0] for x in b]
    same = [("equal", 0, len(a), 0, len(b))]
    for op, i, j, k, m in same if left == right else SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                out.append((yield _merge(x, y)))
        else:
            out += [[s, _loosest(q, "?"), c] for s, q, c in a[i:j] + b[k:m]]
    return (yield _fold(out))


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One stream that generates both: matches merged, what either lacks made optional, repeats folded."""
    return _finish(_align(a, b))


def _pattern(element: Element):
    nodes: list[Node] = []
    for c in _flat(element):
        if isinstance(c, Element):
            nodes.append([c.sign, "1", (yield _pattern(c))])
        elif c and not c.isspace():
            nodes.append(["#", "1", []])
    return (yield _fold(nodes))


def pattern(element: Element) -> list[Node]:
    """A page's own union-free expression."""
    return _finish(_pattern(element))


def written(nodes: list[Node]) -> str:
    """Nodes in preorder, each with its number of children, as JSON without nesting."""
    out: list = [len(nodes)]
    stack = nodes[::-1]
    while stack:
        sign, quantifier, children = stack.pop()
        out += (sign, quantifier, len(children))
        stack += children[::-1]
    return json.dumps(out)


def read(text: str) -> list[Node]:
    flat = json.loads(text)
    top: list[Node] = []
    stack = [(top, flat[0])]
    for i in range(1, len(flat), 3):
        while len(stack[-1][0]) == stack[-1][1]:
            stack.pop()
        node = [flat[i], flat[i + 1], []]
        stack[-1][0].append(node)
        stack.append((node[2], flat[i + 2]))
    return top


#: What keeps a slot out of the main text: nothing, a hint, or an element that is never main text.
FREE, HINTED, NEVER = 0, 1, 2


class Wrapper:
    """A wrapper's nodes by number: their children, and how they stand to the main text."""

    def __init__(self, nodes: list[Node]):
        self.many, self.children, self.by_sign = [False], [[]], [{}]
        self.state, self.inside, self.heading = [FREE], [False], [False]
        stack = [(0, n) for n in nodes[::-1]]
        while stack:
            parent, (sign, quantifier, children) = stack.pop()
            at = len(self.many)
            self.by_sign[parent].setdefault(sign, []).append(len(self.children[parent]))
            self.children[parent].append(at)
            self.many.append(quantifier in "+*")
            self.children.append([])
            self.by_sign.append({})
            name, *marks = sign.rstrip("!").split(".")
            state, inside, heading = self.state[parent], self.inside[parent], self.heading[parent]
            own_header = name == "header" and inside and not marks
            if sign.endswith("!") or name in BOILERPLATE and name != "form" or name == "header" and not own_header:
                state = NEVER
            elif name == "form" or marks and name not in WHOLE and not (name in HEADINGS and inside):
                state = max(state, HINTED)
            self.state.append(state)
            self.inside.append(inside or name in ("article", "main"))
            self.heading.append(heading or name in HEADINGS and inside)
            stack += [(at, c) for c in children[::-1]]

    def step(self, parent: int, place: int, sign: str) -> int:
        """Where among the parent's children the next one of this make stands, after the one at ``place``."""
        places = self.by_sign[parent].get(sign)
        if not places:
            return -1
        i = bisect_right(places, place)
        if i and places[i - 1] == place and self.many[self.children[parent][place]]:
            return place
        return places[i] if i < len(places) else places[-1]  # a group that repeats begins again

    def blocks(self, root: Element) -> list[tuple[int, str]]:
        """(slot, text) of the page's blocks, in page order, without those that are never main text."""
        out: list[tuple[int, str]] = []

        def close(frame: list) -> None:
            text = " ".join("".join(frame[4]).split())
            if text and self.state[frame[3]] != NEVER:
                out.append((frame[3], text))
            frame[3], frame[4] = frame[1], []

        # children left, node, place among its children, slot of the open block, the open block's text
        stack: list[list] = [[_flat(root), 0, -1, 0, []]]
        while stack:
            frame = stack[-1]
            for c in frame[0]:
                sign = c.sign if isinstance(c, Element) else "#" if c and not c.isspace() else ""
                place = self.step(frame[1], frame[2], sign) if sign else -1
                child = 0
                if place >= 0:
                    frame[2], child = place, self.children[frame[1]][place]
                if not isinstance(c, Element):
                    if child and frame[3] == frame[1]:
                        frame[3] = child
                    frame[4].append(" " if c is None else c)
                elif c.inline:  # a marked or hidden inline element: leave its text out, keep the block whole
                    frame[4].append(" ")
                else:
                    close(frame)
                    if place >= 0:
                        stack.append([_flat(c), child, -1, child, []])
                        break
            else:
                close(frame)
                stack.pop()
        return out


def _print(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def body_print(wrapper: Wrapper, blocks: list[tuple[int, str]]) -> int:
    """Fingerprint of a page's body as hints find it: pages that only differ around it are one."""
    free = [t for slot, t in blocks if wrapper.state[slot] == FREE]
    return _print("\n\n".join(free or [t for _, t in blocks]))


def main_text(wrapper: Wrapper, blocks: list[tuple[int, str]], template: set[tuple[int, int]] = frozenset(), counted: set[int] = frozenset()) -> str:
    """The blocks of main slots but for the host's template, those of the article alone if there are any."""
    own = [(slot, t) for slot, t in blocks if wrapper.heading[slot] or (slot, _print(t)) not in template]
    found = [(slot, t) for slot, t in own if wrapper.state[slot] == FREE]
    if not found:
        found = [(slot, t) for slot, t in own if slot in counted]
    inside = any(wrapper.inside[slot] for slot, _ in found)
    return "\n\n".join(t for slot, t in found if wrapper.inside[slot] or not inside)


def with_host(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from columns host and html; the wrapper is nodes as ``written``."""

    def patterns(batches):
        for b in batches:
            found = [written(pattern(parse(h or ""))) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["host", "wrapper"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[Node] | None = None
        for w in sorted(frame["wrapper"]):
            nodes = read(w)
            out = nodes if out is None else align(out, nodes)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [written(out)]})

    distinct = pages.select("host", "html").mapInArrow(patterns, "host string, wrapper string").distinct()
    slices = distinct.withColumn("salt", _salt("wrapper")).groupBy("host", "salt").applyInPandas(merged, "host string, wrapper string")
    return slices.groupBy("host").applyInPandas(merged, "host string, wrapper string")


class _Known:
    """Wrappers that a task has read."""

    def __init__(self):
        self.held: dict[str, Wrapper] = {}

    def __call__(self, text: str) -> Wrapper:
        if text not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            self.held[text] = Wrapper(read(text))
        return self.held[text]


def templates(joined: DataFrame) -> DataFrame:
    """(host, template, counted) from columns host, html and wrapper: the host's constant (slot, text fingerprint), and its hinted slots with counts."""

    def seen(batches):
        known = _Known()
        for b in batches:
            bodies, slots = [], []
            for h, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                wrapper = known(w)
                blocks = wrapper.blocks(parse(h or ""))
                bodies.append(body_print(wrapper, blocks))
                share = lambda slot, wrapper=wrapper: SHARE_INSIDE if wrapper.inside[slot] else SHARE
                texts = {(slot, _print(t)) for slot, t in blocks}
                slots.append([(slot, p, share(slot), wrapper.state[slot] == HINTED) for slot, p in sorted(texts)] + [(slot, None, share(slot), wrapper.state[slot] == HINTED) for slot in sorted({slot for slot, _ in texts})])
            kind = pa.list_(pa.struct([("slot", pa.int32()), ("print", pa.int64()), ("share", pa.float64()), ("hinted", pa.bool_())]))
            rows = [[dict(zip(("slot", "print", "share", "hinted"), x, strict=True)) for x in part] for part in slots]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.int64()), pa.array(rows, kind)], ["host", "body", "slots"])

    found = joined.select("host", "html", "wrapper").mapInArrow(seen, "host string, body long, slots array<struct<slot:int,print:long,share:double,hinted:boolean>>")
    pages = found.dropDuplicates(["host", "body"]).select("host", F.inline("slots"))
    counted = common.materialize(pages.groupBy("host", "slot", "print").agg(F.count("*").alias("n"), F.first("share").alias("share"), F.first("hinted").alias("hinted")).where(F.col("n") >= PAGES), "slots")
    shown = counted.where("print is null").select("host", "slot", F.col("n").alias("pages"), "hinted")
    constant = counted.where("print is not null").drop("hinted").join(shown, ["host", "slot"]).where("n >= share * pages")
    rows = constant.select("host", F.struct("slot", "print").alias("constant"), F.lit(None).cast("int").alias("counted")).unionByName(shown.where("hinted").select("host", F.lit(None).cast("struct<slot:int,print:long>").alias("constant"), F.col("slot").alias("counted")))
    return rows.groupBy("host").agg(F.collect_list("constant").alias("template"), F.collect_list("counted").alias("counted"))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and text of every page."""
    hosted = with_host(pages, key, url, html).withColumn("salt", _salt("k"))
    made = common.materialize(wrappers(hosted), "wrappers")

    def salted(frame: DataFrame) -> DataFrame:
        return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    constant = common.materialize(templates(hosted.join(salted(made), ["host", "salt"])), "templates")
    joined = hosted.join(salted(made.join(constant, "host", "left")), ["host", "salt"]).select("k", "url", "html", "host", "wrapper", "template", "counted")

    def run(batches):
        known, host, template, counted = _Known(), None, frozenset(), frozenset()
        for b in batches:
            texts = []
            for i, (h, of, w) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if of != host:
                    host = of
                    template = {(x["slot"], x["print"]) for x in b.column(5)[i].as_py() or ()}
                    counted = set(b.column(6)[i].as_py() or ())
                wrapper = known(w)
                texts.append(main_text(wrapper, wrapper.blocks(parse(h or "")), template, counted))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["k", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"k {kind}, url string, text string").withColumnRenamed("k", key)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op6_html": op6_html}
SQL: dict[str, str] = {}  # tests compare with texts known by construction
