"""Main text of web pages through wrappers: union-free regular expressions inferred from the pages of each host.

A page becomes a stream of tokens (block tags and text runs), nested by its tags. A wrapper holds, for each element, the
expression of its children: an ordered list of parts, each one token or a repeated group. A further page is aligned with
it from left to right. Where the streams differ, the mismatch is resolved:

* text against text: equal runs stay fixed strings, others become a text slot;
* a token that the wrapper does not have here, or one of the wrapper that is missing: an optional part;
* a token that the page has already passed: a repeated group from its place up to here.

Every token occurs once in an expression (a group is a repetition of optional tokens, so no union is needed), which
keeps wrappers as small as the template whatever the number of pages. Wrappers align with each other by the same rules.
So each task folds its pages into wrappers of their hosts, these are merged in two rounds keyed by host and salt, and a
host with a third of all pages costs no task more than another. Each host's wrapper then says which slots are main text, and each page is
read through it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed_row, partitions, slices, unpacked, written

#: Elements nested deeper than this count as parts of the one at this depth.
DEPTH = 48
#: Names that one element's expression tells apart; further ones are known by their tag alone.
NAMES = 48
#: Nodes of wrappers held before a task passes them on, and salts of the first round of merging.
HELD = 50_000
SALTS = 16
#: Pages of a host that meet its wrapper in one task.
TOGETHER = 2_000

TEXT = "#text"

# Elements of HTML by their part in the layout of a page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object "
    "ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that only lay out others; the densest part of a page is one of these.
LAYOUT = frozenset("html body center div form section table tbody tr td".split())
#: Start tags that end open elements, and the elements that the search for these does not leave.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dd": ("dd dt", "dl"),
    "dt": ("dd dt", "dl"),
    "tr": ("tr td th caption", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "option": ("option", "select optgroup"),
    "optgroup": ("option optgroup", "select"),
    "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: What holds no main text by its tag or by its role attribute.
CHROME_TAGS = frozenset("aside button dialog footer form head menu nav noscript object search select svg template".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name such parts; those of the second list do so within articles too, whatever they hold.
CHROME_WORDS = frozenset(
    "ad ads adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "promotion recommended related rail search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "topbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
MAIN_WORDS = frozenset("article articlebody blogpost body content entry main maincontent post story".split())

_OPEN = r"""<(/?)([a-zA-Z][^\s/>]*)(?:([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|([^>]*)(?:>|\Z))"""
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?/][^a-zA-Z>-][^>]*(?:>|\Z)|<![a-zA-Z>-][^>]*(?:>|\Z)|</>|" + _OPEN, re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Za-z][a-z]*")


@lru_cache(maxsize=65536)
def label_of(tag: str, attributes: str) -> str:
    """``tag.names|kind``: the name of an element with the words of class and id, and what these say of it.

    Kinds: x holds no main text, c is named so, d comments of readers, a an article, m the main part, n is named so.
    """
    words: set[str] = set()
    role = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() in ("class", "id", "itemprop"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name.lower() == "role":
            role = value.strip().lower()
    if words & COMMENT_WORDS:
        kind = "d"
    elif tag in CHROME_TAGS or role in CHROME_ROLES:
        kind = "x"
    elif tag == "article":
        kind = "a"
    elif tag == "main" or role == "main":
        kind = "m"
    elif tag in ("html", "body"):
        kind = ""
    elif tag == "header" or words & CHROME_WORDS:
        kind = "c"
    else:
        kind = "n" if words & MAIN_WORDS else ""
    return f"{tag}{''.join('.' + w for w in sorted(words)[:6])}|{kind}"


def page_tree(page: str) -> list:
    """A page as nested lists: [label, children], a child being such a list or a text run (text, characters in links)."""
    root: list = ["|", []]
    stack: list[tuple[str, list]] = [("", root)]
    pieces: list[str] = []
    linked = in_link = 0

    def ended() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                stack[-1][1][1].append((text, min(linked, len(text))))
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text)

    def left(names: frozenset, walls: frozenset) -> None:
        """Ends the outermost open element of ``names`` inside the nearest of ``walls``."""
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                found = k
            elif stack[k][0] in walls:
                break
        if found:
            del stack[found:]

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            said(page[at:])
            break
        if token.start() > at:
            said(page[at : token.start()])
        at = token.end()
        tag = token.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not token.group(1):
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else size
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = 0 if token.group(1) else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        ended()
        if token.group(1):
            if tag not in ("html", "body"):
                left(frozenset((tag,)), _CELLS if tag not in _TABLE else frozenset(("table",)) if tag != "table" else frozenset())
            in_link = 0
            continue
        if tag in ENDS:
            left(*ENDS[tag])
        elif tag not in ("html", "option", "optgroup"):
            left(_PARAGRAPH, _CELLS)
        if tag in VOID or (tag in ("html", "body") and any(s[0] == tag for s in stack)):
            continue
        if len(stack) > DEPTH:
            stack.append((tag, stack[-1][1]))
            continue
        node = [label_of(tag, token.group(3) or token.group(4) or ""), []]
        stack[-1][1][1].append(node)
        stack.append((tag, node))
    ended()
    return root


_PARAGRAPH = frozenset(("p",))
_CELLS = frozenset(("td", "th", "table", "caption"))
_TABLE = frozenset(("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"))


class Wrapper:
    """One element's expression, with its children's.

    ``count`` is how many of its kind were met, ``held`` in how many parents. A text run has ``size`` and ``linked``
    characters in all and, as long as it never changed, the ``fixed`` string's digest.
    """

    __slots__ = ("count", "held", "size", "linked", "fixed", "parts", "inner")

    def __init__(self) -> None:
        self.count = self.held = self.size = self.linked = 0
        self.fixed: str | None = None
        self.parts: list[list] = []
        self.inner: dict[str, Wrapper] = {}

    def child(self, label: str) -> str:
        """The name under which this expression knows ``label``."""
        if label in self.inner or len(self.inner) < NAMES or label == TEXT:
            return label
        return general(label)

    def place(self, labels: list[str], repeated: bool, cursor: int) -> int:
        """Aligns one part of another stream with the parts from ``cursor`` on; returns the part it is now in."""
        known = [k for k, part in enumerate(self.parts) if not part[1].keys().isdisjoint(labels)]
        if not known:
            self.parts.insert(cursor + 1, [repeated, dict.fromkeys(labels)])
            return cursor + 1
        low, high = known[0], known[-1]
        if low <= cursor:
            high, repeated = max(high, cursor), True
        joined = dict.fromkeys(l for part in self.parts[low : high + 1] for l in part[1])
        joined.update(dict.fromkeys(labels))
        repeated = repeated or high > low or any(part[0] for part in self.parts[low : high + 1]) or len(joined) > 1
        self.parts[low : high + 1] = [[repeated, joined]]
        return low

    def fold(self, children: list) -> int:
        """Aligns the token stream of one more element of this kind; returns how many nodes that added."""
        self.count += 1
        cursor, added, seen = -1, 0, set()
        for child in children:
            run = isinstance(child, tuple)
            label = self.child(TEXT if run else child[0])
            cursor = self.place([label], False, cursor)
            node = self.inner.get(label)
            if node is None:
                node = self.inner[label] = Wrapper()
                added += 1
            if label not in seen:
                seen.add(label)
                node.held += 1
            if run:
                digest = blake2b(child[0].encode(), digest_size=8).hexdigest()
                node.fixed = digest if node.count == 0 or node.fixed == digest else None
                node.count += 1
                node.size += len(child[0])
                node.linked += child[1]
            else:
                added += node.fold(child[1])
        return added

    def merge(self, other: Wrapper) -> Wrapper:
        """Aligns another wrapper of the same element with this one."""
        cursor = -1
        for repeated, labels in other.parts:
            cursor = self.place([self.child(l) for l in labels], repeated, cursor)
            for label in labels:
                name = self.child(label)
                if name in self.inner:
                    self.inner[name].merge(other.inner[label])
                else:
                    self.inner[name] = other.inner[label]
        self.fixed = self.fixed if self.fixed == other.fixed or not other.count else None if self.count else other.fixed
        for field in ("count", "held", "size", "linked"):
            setattr(self, field, getattr(self, field) + getattr(other, field))
        return self

    def expression(self, label: str = "") -> str:
        """The regular expression: {..}+ repeats, (..)? may be absent, #text is a slot and #fixed an unchanging string."""
        out = []
        for repeated, labels in self.parts:
            inside = []
            for name in labels:
                node = self.inner[name]
                said = node.expression(name) if name != TEXT else "#fixed" if node.fixed and self.count > 1 else TEXT
                inside.append(f"({said})?" if node.held < self.count or len(labels) > 1 else said)
            out.append("{" + " ".join(inside) + "}+" if repeated else " ".join(inside))
        tag = label.partition("|")[0]
        return f"<{tag}>{' '.join(out)}</{tag}>" if tag else " ".join(out)

    def packed(self) -> list:
        return [self.count, self.held, self.size, self.linked, self.fixed, [[r, list(l)] for r, l in self.parts], {k: v.packed() for k, v in self.inner.items()}]

    @classmethod
    def unpacked(cls, values: list) -> Wrapper:
        out = cls()
        out.count, out.held, out.size, out.linked, out.fixed, parts, inner = values
        out.parts = [[r, dict.fromkeys(l)] for r, l in parts]
        out.inner = {k: cls.unpacked(v) for k, v in inner.items()}
        return out


def general(label: str) -> str:
    tag, _, kind = label.partition("|")
    return f"{tag.partition('.')[0]}!|{kind}"


def slots(wrapper: Wrapper) -> dict:
    """Which text runs of a host's pages are main text: nested {label: [runs are main text, inner]} of what holds some.

    The first of these that holds text is taken: articles, main parts, parts named as such, and then the part that
    holds nine tenths of the text outside of links. Inside it, what is no main text by tag, role or name goes.
    """
    total = _mass(wrapper)

    def chrome(label: str, node: Wrapper, in_main: bool) -> bool:
        kind = label.rpartition("|")[2]
        if kind == "d":
            return True
        holds_page = 2 * _mass(node) > total and _holds(node, "am")
        if kind == "x":
            return not (label.startswith("form") and holds_page)
        if kind == "c":
            return not holds_page and not (in_main and (label.startswith("header") or ".header" in label))
        return False

    def inside(node: Wrapper, in_main: bool, fixed_too: bool = True) -> list:
        kept = {}
        for label, child in node.inner.items():
            if label == TEXT or chrome(label, child, in_main):
                continue
            found = inside(child, in_main, fixed_too)
            if found[0] or found[1]:
                kept[label] = found
        run = node.inner.get(TEXT)
        return [run is not None and (fixed_too or run.fixed is None), kept]

    def under(node: Wrapper, kinds: str) -> list:
        """The parts of ``kinds``, outermost first, outside of chrome."""
        kept = {}
        for label, child in node.inner.items():
            if label == TEXT or chrome(label, child, False):
                continue
            found = inside(child, True) if label.rpartition("|")[2] in tuple(kinds) else under(child, kinds)
            if found[0] or found[1]:
                kept[label] = found
        return [False, kept]

    def densest(node: Wrapper) -> list:
        for label, child in node.inner.items():
            if label.partition("|")[0].partition(".")[0].rstrip("!") in LAYOUT and not chrome(label, child, False) and 10 * _prose(child) >= 9 * _prose(node) > 0:
                return [False, {label: densest(child)}]
        changing = inside(node, False, False)
        return changing if wrapper.count > 2 and (changing[0] or changing[1]) else inside(node, False)

    for kinds in ("a", "m", "n"):
        found = under(wrapper, kinds)
        if found[1]:
            return {"main": found, "rest": densest(wrapper)}
    return {"main": densest(wrapper), "rest": inside(wrapper, False)}


def _mass(node: Wrapper) -> int:
    return sum(child.size if label == TEXT else _mass(child) for label, child in node.inner.items() if not label.startswith("head|"))


def _prose(node: Wrapper) -> int:
    """Characters outside of links, without what is no main text by its label."""
    return sum(
        child.size - child.linked if label == TEXT else _prose(child)
        for label, child in node.inner.items()
        if label.rpartition("|")[2] not in ("x", "c", "d")
    )


def _holds(node: Wrapper, kinds: str) -> bool:
    return any(label.rpartition("|")[2] in tuple(kinds) or _holds(child, kinds) for label, child in node.inner.items())


def read(tree: list, found: list) -> list[str]:
    """The runs of a page that ``found`` marks, in page order."""
    out = []
    runs, inner = found
    for child in tree[1]:
        if isinstance(child, tuple):
            if runs:
                out.append(child[0])
        else:
            deeper = inner.get(child[0]) or inner.get(general(child[0]))
            if deeper:
                out.extend(read(child, deeper))
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in small letters; '' for what is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


_PARTIAL = "host string, pages long, wrapper string"


def _gather(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, Wrapper] = {}
    nodes = 0
    for batch in batches:
        for part in slices(batch, "html"):
            for host, page in zip(part.column(0).to_pylist(), part.column(1)):
                wrapper = held.get(host)
                if wrapper is None:
                    wrapper = held[host] = Wrapper()
                nodes += wrapper.fold(page_tree(page.as_py())[1]) + 1
            if nodes >= most:
                yield from _flushed(held)
                held, nodes = {}, 0
    yield from _flushed(held)


def _flushed(held: dict[str, Wrapper]) -> Iterator[pa.RecordBatch]:
    for host, wrapper in held.items():
        yield pa.RecordBatch.from_pylist([{"host": host, "pages": wrapper.count, "wrapper": json.dumps(wrapper.packed())}], pa.schema([("host", pa.string()), ("pages", pa.int64()), ("wrapper", pa.string())]))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges wrappers that follow each other and are of one host."""
    host, wrapper = None, None
    for batch in batches:
        for row in batch.to_pylist():
            other = Wrapper.unpacked(json.loads(row["wrapper"]))
            if wrapper is not None and row["host"] == host:
                wrapper.merge(other)
                continue
            if wrapper is not None:
                yield from _flushed({host: wrapper})
            host, wrapper = row["host"], other
    if wrapper is not None:
        yield from _flushed({host: wrapper})


def infer(pages: DataFrame, html_col: str = "html", url_col: str = "url", most: int = HELD) -> DataFrame:
    """host, pages and wrapper (JSON): one wrapper for each host, from all of its pages.

    A task passes its wrappers on when they have ``most`` nodes. Null pages and URLs count as empty ones. Repeated pages change no expression.
    """
    n = partitions(pages.sparkSession)
    taken = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    partial = taken.mapInArrow(lambda batches: _gather(batches, most), _PARTIAL).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = partial.repartition(n, "host", "salt").sortWithinPartitions("host", "salt").drop("salt").mapInArrow(_join, _PARTIAL)
    return some.repartition(n, "host").sortWithinPartitions("host").mapInArrow(_join, _PARTIAL)


def _with_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [json.dumps(slots(Wrapper.unpacked(json.loads(w)))) for w in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["host", "pages", "slots"])


@lru_cache(maxsize=256)
def _slots_of(text: str) -> dict:
    return json.loads(text)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: list[str] | None = None, most: int = HELD, together: int = TOGETHER) -> DataFrame:
    """``pages`` with ``text``, the main text of each page, and ``n_chars``, its code points.

    ``keep`` names the columns that pass (all but the page itself by default); columns named like new ones give way.
    Null and empty pages have the text ''. Null URLs, and URLs without a host, count as one host. Repeated rows give
    repeated rows, ids are not looked at, an empty table gives an empty one. A page in which the wrapper's main part is absent is
    read by the host's next choice of parts.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]
    wrappers = written(infer(pages, html_col, url_col, most).mapInArrow(_with_slots, "host string, pages long, slots string"), "wrappers")
    total = wrappers.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    together = max(together, total // 10_000)
    # At most 10,000 hosts have more pages than that.
    large = F.broadcast(wrappers.where(F.col("pages") > together).select(F.col("host").alias("large_host"), F.ceil(F.col("pages") / together).cast("int").alias("copies")))
    copies = F.ceil(F.col("pages") / together).cast("int")
    lent = wrappers.select("host", "slots", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    packed = pages.select(
        packed_row(kept),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
        host_of(F.col(f"`{url_col}`")).alias("page_host"),
        F.monotonically_increasing_id().alias("order"),
    ).join(large, F.col("page_host") == F.col("large_host"), "left")
    packed = packed.withColumn("page_copy", F.pmod(F.xxhash64("html", "order"), F.coalesce("copies", F.lit(1))).cast("int"))
    both = packed.join(lent, (F.col("page_host") == F.col("host")) & (F.col("page_copy") == F.col("copy"))).select("row", "html", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for page, found in zip(part.column(1), part.column(2).to_pylist()):
                    tree, marks = page_tree(page.as_py()), _slots_of(found)
                    blocks = read(tree, marks["main"]) or read(tree, marks["rest"])
                    texts.append("\n".join(blocks))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])

    done = both.mapInArrow(run, T.StructType([both.schema["row"], T.StructField("text", T.StringType())]))
    return done.select(*unpacked(kept), "text", F.length("text").cast("long").alias("n_chars"))
