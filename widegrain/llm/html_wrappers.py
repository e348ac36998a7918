"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is read as a stream of tags and text slots, nested as its tags are.
Repeated neighbours fold into a repetition.  Pages of one host are aligned with
the host's wrapper one after another: what both have is matched, deeper levels
likewise; what only one has becomes optional; a text that differs becomes a
slot, and one that all pages share stays fixed.  A wrapper has no alternatives,
so wrappers of parts of a host can be aligned with each other as pages are, and
each task folds its pages before anything is shuffled.  A level of a wrapper
with more than WIDE members is loosened: tags stand for themselves without
their classes, and members with one label become one repeated member.

Every page is matched with its host's wrapper, which tells for each text whether
it fills a slot or is fixed.  A text is fixed if at least two pages of the host,
and nearly all, have it at that place and no page has another one there; where a
wrapper has no slots its pages are copies, and it fixes nothing.  From that and
from tags the main text follows:

* Regions whose tag, class, id or role marks them as menus, headers, footers,
  sidebars, notices, adverts, forms or comments are left out.  A mark counts if
  all words of a class token, an id or a role are marks ("cookie-notice", not
  "has-sidebar"); the whole page and headings can't be marked by words.
* Of a page with an article or main region that region is taken, with all texts
  in it.  Inside it, headers and texts that stand in links only are left out if
  the wrapper fixes them (a site's own line, a menu without a telling name) and
  stay if they fill slots (the title).  A region all of whose texts are fixed is
  the host's own, and is passed over if slots outside it are filled.
* Elsewhere only slots are taken, and items of lists that are links are menus.

Forms and marks around a main region don't hide it, nor forms an article; other
articles in marked regions, such as comments, are taken only if no region
outside has text, and what stands in forms only if the rest of the page has
none.

Defined cases: null html gives an empty text; a null url, and one without
"://", has the empty host; a host with a single page has nothing to compare it
with, so its wrapper fixes nothing; cut-off pages are closed where they end, an
unclosed script, style or comment hides the rest; repeated rows are extracted one
by one; page_id may be null or repeat; very long pages are read whole; other
columns are ignored, whatever their names; an empty table gives an empty result.
A line break inside a block counts as white space.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, save
from .urls import split_url

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = "script|style|noscript|template|iframe|svg|math|textarea|select|button|object|canvas|audio|video|title"
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening tag that ends an open element of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that never hold the article's text.
ASIDE_TAGS = frozenset("nav footer aside form head menu dialog fieldset header".split())
#: Words of class, id and role that mark other things than the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login menu navbar navigation nav breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social footer header masthead topbar toolbar comment comments commentlist reply replies disqus respond complementary contentinfo search skip pagination pager toc".split()
)
#: The share of a host's pages that must have a fixed text; cut-off pages lack what comes last.
FIXED_SHARE = 0.9
#: Members of a level of a wrapper before it is loosened, and comparisons of labels that an alignment may take before.
WIDE, CELLS = 96, 200_000
#: Levels of a page's tree; elements further down count to the last one.
DEEP = 150
#: A label beyond this length stands for its hash.
LONG_LABEL = 80
#: Hosts that a task folds at once, and tasks whose partial wrappers are aligned first.
HOSTS_AT_ONCE, TASKS_AT_ONCE = 2_000, 64
#: Wrappers of up to so many bytes in all are broadcast; more meet their pages in a shuffle.
BROADCAST_BYTES = 32 << 20
#: Pages of a large host that meet its wrapper in one place, and the share of all pages that makes a host large.
PAGES_AT_ONCE, LARGE_SHARE = 20_000, 0.001

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S | re.I)
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A slash at a tag's end that isn't part of a value.
_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[a-z]+")

#: Elements that no word marks.
UNMARKED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: How an element is set apart from the article: not, as a form, as a header, by tag or words, or by not being shown.
NONE, FORM, HEADER, MARKED, HIDDEN = range(5)
#: How an element marks the article.
ARTICLE, MAIN = 1, 2

_labels: dict[tuple[str, str], tuple[str, int, int]] = {}


def _aside_word(token: str) -> bool:
    names = _NAMES.findall(token)
    return bool(names) and ASIDE_WORDS.issuperset(names)


def _label(name: str, attrs: str) -> tuple[str, int, int]:
    """(label, how it is set apart from the article, how it marks the article)."""
    known = _labels.get((name, attrs))
    if known is not None:
        return known
    marks, hidden, article = [], False, MAIN if name == "main" else ARTICLE if name == "article" else NONE
    words: set[str] = set()
    if attrs:
        named: dict[str, str] = {}
        for m in _ATTR.finditer(attrs):
            named.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        for key, value in named.items():
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif key in ("class", "id", "role"):
                marks.append(re.sub(r"\d+", "0", value))
                words.update(filter(_aside_word, value.split()))
                if key == "role" and value == "main":
                    article = MAIN
            elif key == "itemprop" and value == "articlebody":
                article = article or ARTICLE
    if name in UNMARKED:
        words.clear()
    marked = (name in ASIDE_TAGS and name not in ("form", "header")) or words - {"header"}
    apart = HIDDEN if hidden else MARKED if marked else HEADER if words or name == "header" else FORM if name == "form" else NONE
    label = "".join((name, *("." + m for m in marks)))
    if len(label) > LONG_LABEL:
        label = f"{name}.{xxhash.xxh3_64_hexdigest(label.encode('utf-8', 'surrogatepass'))}"
    out = label, apart, article
    if len(_labels) > 50_000:
        _labels.clear()
    _labels[name, attrs] = out
    return out


def events(source: str) -> Iterator[tuple[str, str, int, int]]:
    """("open", label, apart, article), ("close", label, ..), ("text", raw, ..) and ("break", ..), properly nested."""
    stack: list[tuple[str, str]] = []

    def close(k: int):
        while len(stack) > k:
            yield "close", stack.pop()[1], NONE, NONE

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            yield "text", source[at : m.start()], NONE, NONE
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                yield from close(k)
            continue
        if name in VOID:
            yield "break", name, MARKED if name == "hr" else NONE, NONE
            continue
        if name in BLOCK:
            # a block ends an open paragraph, and some blocks end their like
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in ENDS.get(name, ()) or (stack[k][0] in BLOCK and stack[k][0] not in ("p",))), None)
            if k is not None and (stack[k][0] == "p" or stack[k][0] in ENDS.get(name, ())):
                yield from close(k)
        label, apart, article = _label(name, m[4])
        if name not in BLOCK and _CLOSED.search(m[4]):
            continue
        stack.append((name, label))
        yield "open", label, apart, article
    if at < len(source):
        yield "text", source[at:], NONE, NONE
    yield from close(0)


# --- wrappers ---------------------------------------------------------------
# A wrapper node is [label, quantifier, children]; "#" is the label of a text
# slot.  Quantifiers: "1", "?" (optional), "+" (repeated), "*" (both).

_JOIN = {(a, b): ("*" if {a, b} & {"*"} or {a, b} == {"?", "+"} else "+" if "+" in (a, b) else "?" if "?" in (a, b) else "1") for a in "1?+*" for b in "1?+*"}


#: What two nodes belong to: one page, different pages, or places of a wrapper that may have pages in common.
PAGE, APART, BESIDE = range(3)


def _both(a: list, b: list, quantifier: str, of: int) -> list:
    """Two nodes of one label as one."""
    if a[0] != "#":
        return [a[0], quantifier, align(a[2], b[2], of)]
    (h, n), (g, m) = a[2], b[2]
    if of == PAGE:  # the texts of one page follow each other
        return ["#", quantifier, [_hash(f"{h},{g}"), 1], a[3] + b[3]]
    return ["#", quantifier, [h if h == g else 0, n + m if of == APART else max(n, m)]]


def _less(node: list, quantifier: str) -> list:
    return [node[0], quantifier, *node[2:]]


def fold(children: list, of: int = BESIDE) -> list:
    """Neighbours of one label become one repeated child."""
    out: list = []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = _both(out[-1], c, "*" if "*" in (out[-1][1], c[1]) else "+", of)
        else:
            out.append(c)
    # a repeated pair or triple of labels folds into a repetition of its members
    for width in (2, 3):
        k = 0
        while k + 2 * width <= len(out):
            if [c[0] for c in out[k : k + width]] == [c[0] for c in out[k + width : k + 2 * width]]:
                merged = [_both(a, b, "*" if "*" in (a[1], b[1]) or "?" in (a[1], b[1]) else "+", of) for a, b in zip(out[k : k + width], out[k + width : k + 2 * width], strict=True)]
                out[k : k + 2 * width] = merged
            else:
                k += 1
    return out


def common(la: list[str], lb: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of labels."""
    if la == lb:
        return [(x, x) for x in range(len(la))]
    n, m = len(la), len(lb)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] == lb[j] else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if la[i] == lb[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _bare(label: str) -> str:
    """A tag that stands for all its classes."""
    return label if label == "#" else label.split(".", 1)[0] + ".*"


def _loose(children: list, of: int) -> list:
    """A level with members of few labels: tags alone, each once."""
    found: dict[str, list] = {}
    for c in children:
        name = _bare(c[0])
        node = [name, *c[1:]]
        found[name] = _both(found[name], node, "*", of) if name in found else node
    return list(found.values())


def shared_labels(a: list, b: list) -> tuple[list[str], list[str]]:
    """Labels of two levels; where one has a tag for all its classes, the other's labels are read so too."""
    la, lb = [c[0] for c in a], [c[0] for c in b]
    if la == lb:
        return la, lb
    sa, sb = set(la), set(lb)
    if any(x.endswith(".*") for x in sb):
        la = [x if x in sb or _bare(x) not in sb else _bare(x) for x in la]
    if any(x.endswith(".*") for x in sa):
        lb = [x if x in sa or _bare(x) not in sa else _bare(x) for x in lb]
    return la, lb


def align(a: list, b: list, of: int = APART) -> list:
    """The least wrapper of this form that matches what either of two child lists matches."""
    beside = PAGE if of == PAGE else BESIDE
    if len(a) * len(b) > CELLS:
        a, b = _loose(a, beside), _loose(b, beside)
    out, i, j = [], 0, 0
    la, lb = shared_labels(a, b)
    for x, y in [*common(la, lb), (len(a), len(b))]:
        out.extend(_less(c, _JOIN[c[1], "?"]) for c in a[i:x])
        out.extend(_less(c, _JOIN[c[1], "?"]) for c in b[j:y])
        if x < len(a) and y < len(b):
            one = _both(a[x], b[y], _JOIN[a[x][1], b[y][1]], of)
            one[0] = la[x]
            out.append(one)
        i, j = x + 1, y + 1
    if len(out) <= max(len(a), len(b)):
        return out
    out = fold(out, beside)
    return _loose(out, beside) if len(out) > WIDE else out


def render(children: list) -> str:
    """A wrapper as an expression."""
    out = []
    for label, q, inner in children:
        body = "#" if label == "#" else f"<{label}>{render(inner)}</{label.split('.')[0]}>"
        out.append(body if q == "1" else f"({body}){q}")
    return "".join(out)


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) or 1


#: Where a text stands: in an article or main region, in an article of a marked region, elsewhere, in a form, in a region that is left out.
REGION, INNER, REST, IN_FORM, GONE = range(5)


class Page:
    """A page's tree, and its texts: (block, place or -1 for a line break, raw text) in page order.

    A text's node has the hash of what stands there, 1, and its places; ranks
    and weak tell for each place where it stands and whether the wrapper may
    leave it out of a region."""

    def __init__(self, source: str):
        self.texts: list[tuple[int, int, str]] = []
        self.ranks: list[int] = []
        self.weak: list[bool] = []
        self.menu: list[bool] = []
        root: list = []
        stack = [root]
        # of the elements around: how they are set apart, since the region's begin if there is one; the region's rank; whether in a header of it, a link, a list's item
        around: list[tuple[int, int, bool, bool, bool]] = [(NONE, REST, False, False, False)]
        block = 0
        for kind, value, apart, article in events(source):
            aside, region, header, link, item = around[-1]
            if kind == "text":
                shown = aside == NONE or (aside == FORM and region == REST)
                self.texts.append((block, len(self.ranks), value))
                self.ranks.append((IN_FORM if aside else region) if shown else GONE)
                self.weak.append(header or link)
                self.menu.append(link and item)
                if shown and not value.isspace():
                    node = ["#", "1", [_hash(_SPACE.sub(" ", value).strip()), 1], [len(self.ranks) - 1]]
                    if stack[-1] and stack[-1][-1][0] == "#":
                        stack[-1][-1] = _both(stack[-1][-1], node, "1", PAGE)
                    else:
                        stack[-1].append(node)
                continue
            if kind == "break":
                self.texts.append((block, -1, " "))
                block += bool(apart)
                continue
            name = value.split(".", 1)[0]
            block += name in BLOCK
            if kind == "close":
                children = stack.pop()
                if children is not stack[-1]:
                    children[:] = fold(children, PAGE)
                around.pop()
                continue
            if len(stack) > DEEP:
                stack.append(stack[-1])
            else:
                stack[-1].append([value, "1", []])
                stack.append(stack[-1][-1][2])
            link, item = link or name == "a", item or name == "li"
            if article and region == REST and apart != HIDDEN and aside != HIDDEN:
                around.append((NONE, REGION if aside <= FORM or article == MAIN else INNER, False, link, item))
            elif article and apart != HIDDEN:
                around.append((aside, region, header, link, item))
            elif apart == HEADER and region != REST:
                around.append((aside, region, True, link, item))
            else:
                around.append((max(aside, apart), region, header, link, item))
        self.tree = fold(root, PAGE)

    def blocks(self, rank: int, without: Callable[[list[int]], bool]) -> list[str]:
        """Texts of the blocks of one rank but for those to be left out, which are asked for by the places of their texts."""
        out, at, parts, places = [], -1, [], []

        def flush():
            if places and not without(places):
                text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    out.append(text)
            parts.clear()
            places.clear()

        for block, place, raw in self.texts:
            if block != at:
                flush()
                at = block
            if place < 0:
                parts.append(raw)
            elif self.ranks[place] == rank:
                parts.append(raw)
                if not raw.isspace():
                    places.append(place)
        flush()
        return out


def _plain(tree: list) -> list:
    """A page's tree without places."""
    return [[label, q, inner] if label == "#" else [label, q, _plain(inner)] for label, q, inner, *_ in tree]


class Wrapper:
    """What is known of a host: the expression, in which a text's node has its hash, or 0 where pages differ, and the number of pages that have it."""

    def __init__(self, tree=None, pages: int = 0):
        self.tree, self.pages = tree or [], pages
        self._slots: bool | None = None

    def add(self, page: Page) -> None:
        tree = _plain(page.tree)
        if tree:
            self.tree = align(self.tree, tree) if self.pages else tree
            self.pages += 1

    def merge(self, other: Wrapper) -> Wrapper:
        self.tree = align(self.tree, other.tree) if self.pages and other.pages else self.tree or other.tree
        self.pages += other.pages
        return self

    def dump(self) -> str:
        return json.dumps([self.tree, self.pages], separators=(",", ":"))

    @staticmethod
    def load(raw: str) -> Wrapper:
        return Wrapper(*json.loads(raw))

    def fixes(self, node: list) -> bool:
        """Whether nearly all pages, two at least, have a text and no page another one there."""
        return bool(node[2][0]) and node[2][1] >= max(2, FIXED_SHARE * self.pages)

    def has_slots(self) -> bool:
        if self._slots is None:
            self._slots, left = False, list(self.tree)
            while left and not self._slots:
                node = left.pop()
                if node[0] == "#":
                    self._slots = not self.fixes(node)
                else:
                    left.extend(node[2])
        return self._slots

    def fixed_places(self, page: Page) -> frozenset[int]:
        """Places of a page's texts that the wrapper fixes; none where it has no slots, as the pages are copies then."""
        out: set[int] = set()
        left = [(page.tree, self.tree)] if self.pages > 1 and self.has_slots() else []
        while left:
            a, b = left.pop()
            if len(a) * len(b) > CELLS:
                continue
            for x, y in common(*shared_labels(a, b)):
                if a[x][0] != "#":
                    left.append((a[x][2], b[y][2]))
                elif self.fixes(b[y]) and a[x][2][0] == b[y][2][0]:
                    out.update(a[x][3])
        return frozenset(out)


def extract(source: str, wrapper: Wrapper | None) -> str:
    """The main text of a page: blocks in page order, joined by two line feeds."""
    page = Page(source)
    fixed = wrapper.fixed_places(page) if wrapper is not None else frozenset()
    own = lambda places: fixed.issuperset(places)
    rest = page.blocks(REST, lambda places: own(places) or all(page.menu[k] for k in places))
    for rank in (REGION, INNER):
        kept = page.blocks(rank, lambda places: own(places) and all(page.weak[k] for k in places))
        if kept and not (rest and own([k for _, k, raw in page.texts if k >= 0 and page.ranks[k] == rank and not raw.isspace()])):
            return "\n\n".join(kept)
    return "\n\n".join(rest or page.blocks(IN_FORM, own) or page.blocks(REST, own))


# --- distributed -------------------------------------------------------------


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) of every host, from all its pages.

    Each task folds its pages; what is shuffled are wrappers, those of
    TASKS_AT_ONCE tasks first."""
    prepare(pages.sparkSession)
    host, _ = split_url(F.col("url"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.dump() for w in held.values()], pa.string())], names=["host", "wrapper"])
            held.clear()
            return made

        for b in batches:
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(h, Wrapper()).add(Page(source))
            if len(held) > HOSTS_AT_ONCE:
                yield out()
        yield out()

    def merge(key, table):
        whole = Wrapper()
        for raw in sorted(table.column("wrapper").to_pylist()):
            whole.merge(Wrapper.load(raw))
        return pa.table({"host": [key[0].as_py()], "wrapper": [whole.dump()], "pages": pa.array([whole.pages], pa.int64())})

    parts = pages.select(host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(learn, "host string, wrapper string")
    near = parts.withColumn("tasks", F.floor(F.spark_partition_id() / TASKS_AT_ONCE))
    once = near.groupBy("host", "tasks").applyInArrow(merge, "host string, wrapper string, pages long")
    return once.groupBy("host").applyInArrow(merge, "host string, wrapper string, pages long")


def _extracted(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of all pages.

    While the wrappers are small in all, each executor gets them, and html isn't
    shuffled.  Beyond BROADCAST_BYTES pages meet their host's wrapper in a
    shuffle; pages of a large host are dealt to several places, each of which
    gets its wrapper."""
    spark = pages.sparkSession
    prepare(spark)
    host, _ = split_url(F.col("url"))
    wrappers = save(infer_wrappers(pages), "wrappers")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    result = f"page_id {kind}, url string, text string, n_chars long"
    sizes = wrappers.agg(F.sum(F.length("wrapper") + F.length("host")).alias("bytes"), F.sum("pages").alias("pages")).first()
    if not sizes["pages"] or sizes["bytes"] <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.select("host", "wrapper").collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[str, Wrapper] = {}
            for b in batches:
                texts = []
                for h, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    w = loaded.get(h)
                    if w is None:
                        w = loaded[h] = Wrapper.load(known.value[h])
                    texts.append(extract(source, w))
                yield _extracted(b, texts)

        return rows.mapInArrow(run, result)

    # at most 1 / LARGE_SHARE hosts are large
    large = wrappers.where(F.col("pages") > LARGE_SHARE * sizes["pages"]).select("host", F.ceil(F.col("pages") / PAGES_AT_ONCE).alias("places"))
    dealt = rows.join(F.broadcast(large), "host", "left").withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.coalesce("places", F.lit(1).cast("long"))))
    every = wrappers.join(F.broadcast(large), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("places", F.lit(1).cast("long")) - 1)))
    none = F.lit(None).cast("string")
    both = every.select("host", "salt", F.lit(0).alias("kind"), F.col("wrapper").alias("html"), none.cast(kind).alias("page_id"), none.alias("url"))
    both = both.unionByName(dealt.select("host", "salt", F.lit(1).alias("kind"), "html", "page_id", "url"))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by host, salt and kind: a host's wrapper, then its pages."""
        wrapper = None
        for b in batches:
            texts = []
            kinds = b.column("kind").to_numpy()
            for k, source in zip(kinds.tolist(), b.column("html").to_pylist(), strict=True):
                if k:
                    texts.append(extract(source, wrapper))
                else:
                    wrapper = Wrapper.load(source)
            yield _extracted(b.filter(pc.equal(b.column("kind"), 1)), texts)

    return both.repartition(partitions(spark), "host", "salt").sortWithinPartitions("host", "salt", "kind").mapInArrow(beside, result)
