"""MinHash near-duplicates by an inverted join over signature coordinates.

A text is the set of its shingles of ``WORDS`` words (A-Z in lower case, words between white space, with fewer words the
whole sequence). Two texts are linked if 100 times their shingles in common are ``percent`` of the shingles of both or
more. Texts with the same set are one node from the start.

1. A signature has ``COORDINATES`` values: the least hash of the set under each of as many random functions. Two sets
   agree in a coordinate with a probability that is their similarity. ``least_matches`` gives the number of equal
   coordinates that a linked pair has but for one in ten million.
2. The first ``POSTED`` coordinates are posted: a row for each (coordinate, value) pair of a node. A pair with enough
   matches has some among these. Lists of one node go.
3. Prefix: lists are ordered by length, short ones first. A node stays in as many of its shortest lists as a linked pair
   may differ in, and one; two linked nodes are then together in one of them. Nodes with too few lists go.
4. Skip: the longest lists are not merged. Collisions there are counted by comparing the signatures of a candidate.
5. A list is not turned into all its pairs. Each list has a hub, the member whose lists are the longest in sum: among
   copies of one text that is the text that most of them are like. Members are compared with hubs, links that hold are
   contracted to components. Only lists whose members are then still in different components are compared whole, in
   blocks of bounded size, inside a task that has the sets of the block and passes on no more links than hold its
   components together. A pair is compared in the first list that it shares.

With ``anchored`` there is a step in front of the hubs: each set also has a SimHash fingerprint, those of all nodes are
linked by the anchors of ``simhash``, and these links, too, are decided on the whole sets, unless their nodes are in one
component by then. Anchors reach four bits, which most pairs at 80 percent exceed; the coordinates find the rest, so the components are the same with and without.

Every link is decided on the whole sets. So what is lost is lost in step 1 only, and nothing is linked that is not alike.
A node is known by 64 bits of hash; different sets with equal hashes are one in 2**64 pairs.

Cases: null texts and texts without words have an empty set and are linked with nothing (``kept`` has one of them,
as they are equal); rows with a null key take part, a null key is the least one only where a component has no other;
repeated rows stay; an empty table gives an empty table; other columns are not read, or pass through untouched in ``kept``. A
very long text is one row, its set in memory in one task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.llm import simhash
from stepview.llm.shared import beside, col, drop, map_batches, new_path, saved, scope
from stepview.llm.shingles import plain, shingles

WORDS, PERCENT, SEED = 5, 85, 42
COORDINATES, POSTED = 64, 40
#: Probability to lose a link.
LOST = 1e-7
#: Members and bytes of sets of a list that are one block.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Rounds with hubs.
ROUNDS = 2
#: Marks of keys that are looked for in the table: 2**18 numbers of 64 bits, 2 MB.
MARKS = 1 << 18

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, COORDINATES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def least_matches(percent: int) -> int:
    """The most equal coordinates that sets at ``percent`` have, but for a probability of ``LOST``."""
    p, below = percent / 100, 0.0
    for n in range(COORDINATES + 1):
        below += math.comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)
        if below > LOST:
            return n
    return COORDINATES


def signature(found: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs of a set of hashes: the number of the coordinate in the low bits, the least hash above."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):
        np.minimum(out, (found[None, at : at + 256] * _FACTORS[0] + _FACTORS[1]).min(axis=1), out=out)
    return (out & np.uint64(~(COORDINATES - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(COORDINATES, dtype=np.uint64)


def _set(text: bytes | None) -> np.ndarray:
    return shingles(plain(text), WORDS)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED) - (1 << 63)


def fingerprints(docs: DataFrame, text: str, into: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with a hash of the set of each whole text as BIGINT."""
    both, place, n = beside(docs, keep, text)
    schema = T.StructType([*both.schema.fields[:n], T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_node(_set(x.as_py())) for x in batch.column(place).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.int64())], names=schema.names)

    return map_batches(both, run, schema)


def signatures(docs: DataFrame, anchored: bool = False) -> DataFrame:
    """Of (``key``, ``text``): ``key``, node ``fp``, number of shingles, signature; ``anchored``: and the SimHash ``print`` of the set."""
    more, printed = ", print bigint" if anchored else "", simhash.majority
    schema = T.StructType([docs.schema["key"], *T.StructType.fromDDL("fp bigint, n bigint, coordinates array<bigint>" + more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps, sizes, values, prints = [], [], [], []
                for x in part.column(1).cast(pa.binary()):
                    found = _set(x.as_py())
                    fps.append(_node(found))
                    sizes.append(len(found))
                    values.append(signature(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
                    if anchored:
                        prints.append(printed(found))
                ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))
                last = [pa.array(np.array(prints, np.uint64).view(np.int64))] if anchored else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), lists, *last], names=schema.names)

    return docs.select("key", "text").mapInArrow(run, schema)


def places(nodes: DataFrame, percent: int) -> DataFrame:
    """``list``, ``fp``, ``weight``: the lists that each node is compared in, and how long all its lists are."""
    # Of the coordinates that are not posted all may match.
    matches = max(1, least_matches(percent) - (COORDINATES - POSTED))
    posts = nodes.select("fp", F.explode(F.slice("coordinates", 1, POSTED)).alias("list"))
    counts = posts.groupBy("list").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    held = posts.join(saved(counts, "counts"), "list").groupBy("fp")
    held = held.agg(F.sort_array(F.collect_list(F.struct("many", "list"))).alias("lists"), F.sum(F.log2("many") * 1024).cast("bigint").alias("weight"))
    prefix = F.slice("lists", 1, F.size("lists") - F.lit(matches - 1))
    placed = held.where(F.size("lists") >= matches).select("fp", "weight", F.explode(prefix).alias("at"))
    return placed.select(F.col("at.list").alias("list"), "fp", "weight")


def members(placed: DataFrame) -> DataFrame:
    """``placed`` without lists of one node and, of lists with the same nodes, all but one."""
    mixed = F.xxhash64("fp")
    lists = placed.groupBy("list").agg(F.count(F.lit(1)).alias("many"), F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64(mixed)).alias("y"))
    lists = lists.where("many > 1").groupBy("many", "x", "y").agg(F.min("list").alias("list"))
    return placed.join(saved(lists.select("list"), "lists"), "list")


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp``, ``set``: shingles of the nodes in ``wanted`` (``fp``, ``first``: a key with that text)."""
    slot = F.pmod(F.xxhash64("key"), F.lit(MARKS * 64))
    word, mark = F.shiftright(slot, 6), F.expr("shiftleft(1L, cast(slot & 63 as int))")
    asked = wanted.select(F.col("first").alias("key")).select(slot.alias("slot"))
    marks = saved(asked.select(F.shiftright("slot", 6).alias("word"), mark.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks")), "marks")
    # Not more than MARKS rows, whatever is wanted. Where nearly all is marked, nearly all texts are read once more.
    near = docs.withColumn("slot", slot).join(F.broadcast(marks), word == F.col("word")).where(F.expr("(marks & shiftleft(1L, cast(slot & 63 as int))) <> 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [_set(x.as_py()) for x in batch.column(0).slice(at, 256).cast(pa.binary())]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, found), pa.int64()), lists], names=["fp", "set"])

    found = near.select("text").mapInArrow(run, "fp bigint, set array<bigint>")
    return found.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def verified(pairs: DataFrame, nodes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) with enough matches whose sets are alike."""
    one, two = (nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("coordinates").alias(f"of_{k}")) for k in "ab")
    sized = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    matched = F.size(F.array_intersect("of_a", "of_b")) >= least_matches(percent)
    close = pairs.join(two, "b").join(one, "a").where(sized & matched).select("a", "b", "n_a", "n_b")
    left, right = (found.select(F.col("fp").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    # The hub's set comes last, so that it is not sent along with each of its members.
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = saved(close, "close").join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", both.alias("both"))
    return joined.where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b")


def labelled(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of lists with nodes of different components: ``list``, ``fp``, ``weight``, ``root``."""
    named = saved(placed.join(roots, placed["fp"] == roots["node"], "left").select("list", "fp", "weight", F.coalesce("root", "fp").alias("root")), "named")
    mixed = named.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return saved(named.join(saved(mixed.select("list"), "mixed"), "list"), "open")


def _hubs(open_lists: DataFrame) -> DataFrame:
    top = open_lists.groupBy("list").agg(F.max(F.struct("weight", "fp", "root")).alias("top"))
    return saved(top.select("list", F.col("top.weight").alias("hub_weight"), F.col("top.fp").alias("hub"), F.col("top.root").alias("hub_root")), "hubs")


class _Block:
    """Members of a list, or of two blocks of it, in order of their nodes."""

    def __init__(self, group: pa.Table, percent: int):
        self.group = group.combine_chunks().sort_by("fp")
        self.percent, self.matches = percent, least_matches(percent)
        self.crossed = self.group["i"][0].as_py() != self.group["j"][0].as_py()
        self.fp, root, self.n, self.block = (self.group[c].to_numpy() for c in ("fp", "root", "n", "block"))
        self.root = root.copy()
        self.sketch = np.stack([x.values.to_numpy() for x in self.group["sketch"]])

    def candidates(self, x: int) -> np.ndarray:
        """Members behind ``x`` in other components whose sizes and sketches allow a link, likely ones first."""
        y = np.arange(x + 1, len(self.fp))
        n, least = self.n, self.percent
        y = y[(self.root[y] != self.root[x]) & (100 * np.minimum(n[y], n[x]) >= least * np.maximum(n[y], n[x]))]
        if self.crossed:
            y = y[self.block[y] != self.block[x]]
        same = (self.sketch[y] == self.sketch[x]).sum(axis=1)
        return y[np.argsort(-same, kind="stable")][: int((same >= self.matches).sum())]


def _screen(percent: int) -> Callable[[pa.Table], pa.Table]:
    """The members of a group that have a candidate in it."""

    def run(group: pa.Table) -> pa.Table:
        block = _Block(group, percent)
        wanted = np.zeros(len(block.fp), bool)
        for x in range(len(block.fp) - 1):
            y = block.candidates(x)
            wanted[y] = True
            wanted[x] |= len(y) > 0
        return block.group.select(["list", "i", "j", "fp"]).filter(pa.array(wanted))

    return run


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links that hold together what is alike in a group, by comparing whole sets."""

    def run(group: pa.Table) -> pa.Table:
        block = _Block(group, percent)
        group, root, here = block.group, block.root, block.group["list"][0].as_py()
        lists = [x.values.to_numpy() for x in group["lists"]]
        padded = np.full((len(lists), max(map(len, lists))), here)
        for row, some in zip(padded, lists):
            row[: len(some)] = some
        whole = [x.values.to_numpy().view(np.uint64) for x in group["set"]]
        a, b = [], []
        for x in range(len(lists) - 1):
            y = block.candidates(x)
            y = y[~np.isin(padded[y], lists[x][lists[x] < here]).any(axis=1)]
            for other in y.tolist():
                if root[other] != root[x] and _alike(whole[x], whole[other], percent):
                    root[root == root[other]] = root[x]
                    a.append(block.fp[x])
                    b.append(block.fp[other])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def compared(open_lists: DataFrame, nodes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is alike within each of the lists, from comparisons of all their members in different components.

    Sketches, a few bits of each coordinate, are compared first; sets go only to where a sketch leaves something to decide."""
    own = open_lists.groupBy("fp").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    few = F.transform("coordinates", lambda c: F.shiftright(c, 6).bitwiseAND(127).cast("tinyint"))
    full = saved(own.join(nodes.select("fp", "n", few.alias("sketch")), "fp"), "full")
    sized = saved(open_lists.join(full.select("fp", "n", "sketch"), "fp"), "sized")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    counts = saved(sized.groupBy("list").agg(blocks.alias("blocks")), "blocks")
    rest = ["fp", "root", "n", "sketch"]
    placed = sized.join(counts, "list").select("list", *rest, "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    dealt = placed.select("list", *rest, "block", F.inline(pairs))
    at = ["list", "i", "j", "fp"]
    wanted = saved(dealt.groupBy("list", "i", "j").applyInArrow(_screen(percent), "list bigint, i int, j int, fp bigint"), "wanted")
    carried = dealt.join(wanted, at, "left_semi").join(full.select("fp", "lists"), "fp").join(found, "fp")
    return carried.groupBy("list", "i", "j").applyInArrow(_compare(percent), "a bigint, b bigint")


def anchored_pairs(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of nodes with equal prints, or with prints linked by ``simhash``; one node of each print stands for it."""
    standing = saved(nodes.groupBy("print").agg(F.min("fp").alias("a")), "prints")
    equal = nodes.join(standing, "print").where("fp <> a").select("a", F.col("fp").alias("b"))
    one, two = (standing.select(F.col("print").alias(f"print_{k}"), F.col("a").alias(k)) for k in "ab")
    met = simhash.links(standing.select("print")).toDF("print_a", "print_b")
    return equal.unionByName(met.join(two, "print_b").join(one, "print_a").select("a", "b"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose nodes are in different components."""
    for k in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def links(nodes: DataFrame, docs: DataFrame, percent: int, anchored: bool = False) -> DataFrame:
    """``a``, ``b``: links and shortcuts along them that connect all that are alike."""
    placed = saved(members(saved(places(nodes, percent), "places")), "members")
    found = saved(sets(docs, placed.select("fp").distinct().join(nodes.select("fp", "first"), "fp")), "sets")
    # At first each node is compared with the best of its hubs only.
    hubs = _hubs(placed.withColumn("root", F.col("fp")))
    best = placed.join(hubs, "list").where("fp <> hub").groupBy("fp").agg(F.max(F.struct("hub_weight", "hub")).alias("top"))
    first = best.select(F.col("top.hub").alias("a"), F.col("fp").alias("b"))
    if anchored:
        # A large group has several links a node: one each is decided now, in the first round those that still join two components.
        close = saved(anchored_pairs(nodes), "anchored")
        first = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(first).distinct()
    tried = saved(first, "first")
    sure = saved(verified(tried, nodes, found, percent), "sure")
    for k in range(ROUNDS):
        roots = simhash.components(sure)
        rest = labelled(placed, roots)
        hubs = _hubs(rest)
        more = rest.join(hubs, "list").where("root <> hub_root").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
        if anchored and k == 0:
            more = more.unionByName(apart(close, roots))
        more = saved(more.distinct().join(tried, ["a", "b"], "left_anti"), "more")
        tried = tried.unionByName(more)
        # What is connected already goes on as stars, which later rounds need not find again.
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        sure = saved(stars.unionByName(verified(more, nodes, found, percent)), "sure")
    roots = simhash.components(sure)
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stars.unionByName(compared(labelled(placed, roots), nodes, found, percent))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, anchored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (``key``, ``fp``, ``n``) and nodes (``fp``, ``root``, ``first``: least key of the component)."""
    spark = docs.sparkSession
    docs = docs.select(col(key).alias("key"), col(text).alias("text"))
    path = new_path(spark, "signatures")
    signatures(docs, anchored).write.parquet(path)
    signed = spark.read.parquet(path)
    rows = saved(signed.select("key", "fp", "n"), "rows")
    with scope(spark):
        of_node = ["n", "coordinates", *["print"] * anchored]
        each = signed.groupBy("fp").agg(F.min("key").alias("first"), *[F.first(c).alias(c) for c in of_node])
        nodes = saved(each, "nodes")
        drop(spark, path)
        roots = simhash.components(links(nodes, docs, percent, anchored))
        rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left")
        rooted = saved(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
        least = saved(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
        found = rooted.join(least, "root").select("fp", "root", F.col("least").alias("first"))
        return rows, saved(found, "groups", outer=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (it is its component's least) of every row."""
    rows, grouped = groups(docs, key, text, percent)
    least = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("first"))
    out = rows.join(grouped, "fp").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, anchored: bool = False) -> DataFrame:
    """``docs`` with one row of each component: a row with the least key, of equal keys any one."""
    return simhash.kept(docs, key, text, functools.partial(groups, percent=percent, anchored=anchored), fingerprints)
