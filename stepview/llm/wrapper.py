"""Main text of web pages by wrapper induction.

A page is read into a tree of its block elements; neighbours of the same kind, such as
the paragraphs of an article or the entries of a menu, are one repeated node. The trees of
pages of the same host are aligned by simple tree matching with a few reference
pages of that host, and with a few of the same layout: the upper levels of the tree. A text that stands at an
aligned node on most pages of the host, or of the layout, is
constant: it belongs to the template. What varies at a node is a slot. Slots of the
article are the content; those that the template itself marks as a menu, header, footer,
sidebar, notice, advert, form or comments (by element, role, class or id) are not.

A mark is a whole name of a class or id, or a name made of words that begins or ends with one in the way such names are
made (``site-footer``, ``ad-slot``, but not ``has-sidebar`` or ``share-price``). The page's root, body and main element are never
marked, the outermost article is not either, and only whole names around it count. Constant headings within the article stay
if what they head varies.

Only trees of hashes are exchanged between tasks, never pages: references are
``REFERENCES`` pages for each host and layout, votes on constants are summed before they are shuffled, and the
constants of a host are at most the texts of its references. Pages that are equal in
all texts vote once, so copies of a page don't make it a template.

Lists of children of any length are matched in one way: first those that are the same on both sides and stand there once, then
what lies between by the largest matching. Its size depends on labels alone, so it is worked out once for each pair of different
shapes, and children of the same shapes in front are matched as they are. For the rest the time grows with the product of the
lengths, the memory with one length times the root of the other.

Cases: a null or empty page, and one without an article's text, has an empty text; a null url is a
host of its own; hosts and layouts with fewer than ``LEAST`` different pages have no constants; repeated rows
each have their own result; an empty table gives none; other columns are not read.
Unclosed elements end where HTML lets them end; pages may be of any length.
"""

from __future__ import annotations

import bisect
import functools
import html
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.llm.shared import col, saved, scope

#: Reference pages of a host; different pages from which on it has a template; share of them that a constant is on.
REFERENCES, LEAST, SHARE = 4, 8, 0.5
#: Levels below which elements count as part of the one above, in trees only; levels that make a layout; sizes that are kept in memory.
DEEPEST, LAYOUT, KNOWN = 40, 4, 1 << 18

#: Fixed values of HTML: elements that break a text into blocks, those without content, and those whose content isn't markup.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul noscript template iframe object button textarea svg".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Elements, roles, and words of classes and ids that mark what isn't the article.
NOT_TEXT = frozenset("head title script style noscript template iframe object button select option textarea svg nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations footer cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social comment comments commentlist reply replies respond disqus discussion search pagination pager skip "
    "popular trending outbrain taboola masthead topbar copyright disclaimer toolbar form".split()
)
#: Marks of a page's head, that within an article are its own.
HEADS = frozenset(["header", "head"])
#: First words of names that say something about what they stand at, not what it is; last words of names of parts.
ABOUT = frozenset("no has with without page tag category cat post entry is not layout type single format template theme hide show js".split())
PARTS = frozenset(
    "bar box block list links link item items section wrapper wrap container area slot left right top bottom form panel popup "
    "message banner inner unit menu buttons icons posts articles stories content body text author thread".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption legend summary".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BREAKS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _marked(name: str, marks: frozenset[str]) -> int:
    """Does the name of a class or id mark its element? 2: it is a mark, 1: it is made of words with one, 0: it isn't."""
    words = [w.lower() for w in _BREAKS.split(name) if w]
    if len(words) < 2:
        return 2 * (bool(words) and words[0] in marks)
    if words[0] in ABOUT:
        return 0
    return int(words[-1] in marks or (words[0] in marks and words[-1] in PARTS))


@functools.lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, bool, int, bool, bool]:
    """Label; whether it is no text by its kind; by its names (as ``_marked``); whether it is a head; whether it holds the article."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [n for k in ("class", "id") for n in found.get(k, "").split()]
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    away = tag in NOT_TEXT or role in ROLES or hidden
    by_name = max([0, *(_marked(n, MARKS) for n in names)])
    head = tag == "header" or any(_marked(n, HEADS) for n in names)
    article = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
    if tag in ("html", "body", "main") or role == "main":
        away, by_name, head = hidden and tag == "main", 0, False
    label = ".".join([tag, *sorted({n for n in found.get("class", "").lower().split() if not re.search(r"\d", n)})])
    return label, away, by_name, head, article


class Page:
    """Blocks of a page: path of labels, text, key, and whether it is off the article or inside one."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[tuple[str, ...], str, int, bool, bool]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        # Of each open element: tag, path, away (3 by its kind, else as ``_marked``), inside an article.
        stack: list[tuple[str, tuple[str, ...], int, bool]] = [("", (), 0, False)]
        pieces: list[str] = []

        def close() -> None:
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    _, path, away, inside = stack[-1]
                    key = xxhash.xxh64_intdigest("\0".join((*path, text))) - (1 << 63)
                    self.blocks.append((path, text, key, away > 0, inside))

        at, match = 0, _TOKEN.search
        while (m := match(source, at)) is not None:
            if m.start() > at:
                pieces.append(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if m[1] or m[4]:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                if depth or tag in BLOCKS:
                    close()
                if depth:
                    del stack[depth:]
                continue
            attributes = m[3] or m[6] or ""
            if tag in RAW:
                end = _raw_end(tag).search(source, at)
                close()
                at = end.end() if end else len(source)
                continue
            if tag in VOID:
                if tag == "hr":
                    close()
                continue
            if tag not in BLOCKS:
                if attributes and "=" in attributes:
                    _, away, by_name, _, _ = _element(tag, attributes)
                    if (away or by_name) and not attributes.rstrip().endswith("/"):
                        # An inline element that is marked ends the block, like one that breaks it.
                        close()
                        self._open(stack, tag, attributes)
                elif tag in NOT_TEXT:
                    close()
                    self._open(stack, tag, attributes)
                continue
            close()
            if stack[-1][0] == "p":
                stack.pop()
            if tag in ENDS:
                ended, stop_at = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in stop_at:
                        break
                    if stack[k][0] in ended:
                        del stack[k:]
                        break
            self._open(stack, tag, attributes)
        if at < len(source):
            pieces.append(source[at:])
        close()

    @staticmethod
    def _open(stack: list[tuple[str, tuple[str, ...], int, bool]], tag: str, attributes: str) -> None:
        _, path, away, inside = stack[-1]
        label, kind, by_name, head, article = _element(tag, attributes)
        if len(path) < DEEPEST:
            path = (*path, label)
        if article and not inside:
            # The article itself: names made of words around it, and its own, don't count.
            away, by_name = away if away > 1 and tag != "main" else 0, 0
        stack.append((tag, path, max(away, 3 * kind, by_name, head and not inside and not article), inside or article))

    def content(self, constants: set[int]) -> str:
        """Blocks of the slots that hold the article, in order."""
        shown = [b for b in self.blocks if not b[3]]
        varying = [b for b in shown if b[2] not in constants]
        if any(b[4] for b in varying):
            within = {b[0][:k] for b in varying if b[4] for k in range(len(b[0]))}
            heads = {id(b) for b in shown if b[4] and b[0] and b[0][-1].split(".")[0] in HEADINGS and b[0][:-1] in within}
            varying = [b for b in shown if b[4] and (b[2] not in constants or id(b) in heads)]
        return "\n\n".join(b[1] for b in varying)

    def tree(self) -> list:
        """Label, keys of the texts, children; neighbours of one label are one node."""
        root: list = ["", [], []]
        for path, _, key, _, _ in self.blocks:
            node = root
            for label in path:
                if not node[2] or node[2][-1][0] != label:
                    node[2].append([label, [], []])
                node = node[2][-1]
            node[1].append(key)
        return root


@functools.cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{tag}[^>]*>", re.I)


def _anchors(one: list[int], two: list[int]) -> list[tuple[int, int]]:
    """Places of what stands once on either side and is the same, as many as keep their order."""
    at = {}
    for k, x in enumerate(two):
        at[x] = None if x in at else k
    seen: dict[int, int | None] = {}
    for k, x in enumerate(one):
        seen[x] = None if x in seen else k
    pairs = [(k, at[x]) for x, k in seen.items() if k is not None and at.get(x) is not None]
    # Longest increasing subsequence of the second places.
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, k) in enumerate(pairs):
        place = bisect.bisect_left(ends, k)
        before.append(last[place - 1] if place else -1)
        ends[place : place + 1], last[place : place + 1] = [k], [n]
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


class Shapes:
    """Trees without their texts as numbers, equal ones with equal numbers; sizes of matchings depend on these alone."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.wholes: dict[tuple, int] = {}
        #: Of each number: label, numbers of the children, nodes in all.
        self.shapes: list[tuple[str, tuple[int, ...], int]] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, node: list) -> tuple[int, int, list, list]:
        """Number, number of the tree with its texts, node, and its children in this form."""
        children = [self.of(x) for x in node[2]]
        below = tuple([x[0] for x in children])
        number = self.numbers.setdefault((node[0], below), len(self.shapes))
        if number == len(self.shapes):
            self.shapes.append((node[0], below, 1 + sum(self.shapes[x][2] for x in below)))
        whole = self.wholes.setdefault((node[0], tuple(node[1]), tuple([x[1] for x in children])), len(self.wholes))
        return number, whole, node, children

    def size(self, x: int, y: int) -> int:
        """Nodes in the largest matching that keeps order and levels."""
        if x == y:
            return self.shapes[x][2]
        if self.shapes[x][0] != self.shapes[y][0]:
            return 0
        found = self.known.get((x, y))
        if found is None:
            one, two = self.shapes[x][1], self.shapes[y][1]
            k = _same(one, two)
            found = 1 + sum(self.shapes[c][2] for c in one[:k])
            if k < min(len(one), len(two)):
                row = np.zeros(len(two) - k + 1, np.int32)
                for row in self._rows(one[k:], self._weights(two[k:]), row):
                    pass
                found += int(row[-1])
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[x, y] = found
        return found

    def _weights(self, two: Sequence[int]) -> Callable[[int], np.ndarray]:
        """For a shape, the sizes of its matchings with each of ``two``; worked out once for each pair of different shapes."""
        kinds, place = np.unique(np.array(two), return_inverse=True)
        of = functools.cache(lambda x: np.array([self.size(x, y) for y in kinds.tolist()], np.int32))
        return functools.lru_cache(16)(lambda x: of(x)[place])

    @staticmethod
    def _rows(one: Sequence[int], weights: Callable[[int], np.ndarray], above: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of the table of best sizes, from the one below ``above`` on."""
        for x in one:
            row = np.zeros_like(above)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights(x)), out=row[1:])
            yield row
            above = row

    def matched(self, one: Sequence[int], two: Sequence[int]) -> list[tuple[int, int]]:
        """Places of the pairs of two lists that are matched; of several best ways the one that leaves out what comes last.

        What is the same in front is matched as it is: so does every best way that prefers early places. Of the table
        for the rest, some rows are kept, and the rows between them worked out again on the way back."""
        k = _same(one, two)
        pairs = [(i, i) for i in range(k)]
        i, j = len(one) - k, len(two) - k
        if not i or not j:
            return pairs
        rest, weights = one[k:], self._weights(two[k:])
        step = math.isqrt(i) + 1
        row = np.zeros(j + 1, np.int32)
        marks = [row]
        for n, row in enumerate(self._rows(rest, weights, row), 1):
            if n % step == 0:
                marks.append(row)
        while i and j:
            first = (i - 1) // step * step
            best = [marks[first // step], *self._rows(rest[first:i], weights, marks[first // step])]
            while i > first and j:
                if best[i - first][j] == best[i - first - 1][j]:
                    i -= 1
                elif best[i - first][j] == best[i - first][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((k + i, k + j))
        return pairs

    def pairs(self, a: tuple[int, int, list, list], b: tuple[int, int, list, list]) -> Iterator[tuple[list, list]]:
        """Pairs of nodes of two trees whose labels are the same."""
        yield a[2], b[2]
        one, two, i, j = a[3], b[3], 0, 0
        for p, q in [*_anchors([x[1] for x in one], [x[1] for x in two]), (len(one), len(two))]:
            for k, n in self.matched([x[0] for x in one[i:p]], [x[0] for x in two[j:q]]):
                yield from self.pairs(one[i + k], two[j + n])
            if p < len(one):
                yield from self.pairs(one[p], two[q])
            i, j = p + 1, q + 1


def _same(one: Sequence[int], two: Sequence[int]) -> int:
    """How many are the same in front."""
    return next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))


def align(a: list, b: list, shapes: Shapes | None = None) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: pairs of nodes that keep order and levels, and their number.

    Children that are the same and stand once are matched first; between them the largest matching counts."""
    if a[0] != b[0]:
        return 0, []
    shapes = shapes or Shapes()
    pairs = list(shapes.pairs(shapes.of(a), shapes.of(b)))
    return len(pairs), pairs


def shared_texts(tree: list, references: list[list]) -> set[int]:
    """Texts that stand at aligned nodes of a page and of a reference."""
    out: set[int] = set()
    shapes = Shapes()
    for other in references:
        for x, y in align(tree, other, shapes)[1]:
            if x[1] and y[1]:
                out.update(set(x[1]).intersection(y[1]))
    return out


@functools.lru_cache(maxsize=2_000)
def _tree(written: str) -> list:
    return json.loads(written)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def layout(tree: list, levels: int = LAYOUT) -> str:
    """Labels of the upper levels of a tree."""
    return f"{tree[0]}({','.join(layout(x, levels - 1) for x in tree[2])})" if levels else tree[0]


def trees(pages: DataFrame, url: str, source: str) -> DataFrame:
    """``host`` and ``tree`` (JSON) of each page, and its ``layout`` as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Page(x.as_py()).tree() for x in batch.column(1)]
            written = [json.dumps(x, separators=(",", ":")) for x in read]
            kinds = [xxhash.xxh64_intdigest(layout(x)) - (1 << 63) for x in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.string()), pa.array(kinds, pa.int64())], names=["host", "tree", "layout"])

    return pages.select(host(col(url)).alias("host"), col(source).alias("html")).mapInArrow(run, "host string, tree string, layout bigint")


def constants(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``host`` and ``keys`` of the texts that its template holds; hosts without any are missing."""
    with scope(pages.sparkSession):
        # Pages with the same texts at the same places count once.
        different = saved(trees(pages, url, source).distinct(), "trees")
        # Each page votes in its host and in its layout.
        groups = F.explode(F.array(F.lit(None).cast("bigint"), F.col("layout")))
        placed = different.select("host", groups.alias("layout"), F.xxhash64("tree").alias("h"), "tree")
        group = [F.coalesce(F.col("host"), F.lit("")).alias("host"), F.coalesce(F.col("layout").cast("string"), F.lit("")).alias("layout"), "h"]
        narrow = placed.select(*group)
        numbers = saved(narrow.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "groups")
        least = narrow.groupBy("host", "layout", F.pmod("h", F.lit(REFERENCES)).alias("k")).agg(F.min("h").alias("h"))
        least = saved(least.join(numbers, ["host", "layout"]).select("host", "layout", "h"), "least")
        chosen = placed.select(*group, "tree").join(least, ["host", "layout", "h"])
        references = saved(chosen.groupBy("host", "layout").agg(F.collect_list("tree").alias("references")), "references")

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, keys = [], []
                for i, (tree, others) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    same = shared_texts(json.loads(tree), [_tree(x) for x in others])
                    of += [i] * len(same)
                    keys += same
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.int64())], names=["host", "layout", "key"])

        asked = placed.select(*group, "tree").join(references, ["host", "layout"]).select("host", "layout", "tree", "references")
        voted = asked.mapInArrow(vote, "host string, layout string, key bigint")
        counts = saved(voted.groupBy("host", "layout", "key").agg(F.count(F.lit(1)).alias("votes")), "votes")
        agreed = counts.join(numbers, ["host", "layout"]).where(F.col("votes") >= SHARE * F.col("n"))
        return saved(agreed.groupBy("host").agg(F.collect_set("key").alias("keys")), "constants", outer=True)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    known = constants(pages, url, source).withColumnRenamed("host", "of")
    plain = pages.select(col(key).alias("page_id"), col(url).alias("url"), col(source).alias("html"), host(col(url)).alias("host"))
    both = plain.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "keys")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, keys in zip(batch.column(2), batch.column(3), strict=True):
                some = keys.values.to_numpy() if keys.is_valid else np.zeros(0, np.int64)
                texts.append(Page(page.as_py()).content(set(some.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = both.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
