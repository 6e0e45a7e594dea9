"""Resharding by minimum-cost flow.

Documents lie in old shards of uneven size; the new shards have capacities. A block is
what a hash of key and text puts together within an old shard: the unit that moves.
Sizes of blocks are summed up in Spark, at most ``shards * BLOCKS`` rows, and the
plan is made from those sums alone:

1. A minimum-cost flow from old shards to new ones says how many bytes stay and how many go
   where, with the fewest bytes moved (or the least cost, given costs for each pair).
2. Blocks are dealt along the flow, large ones first, each to the target of its shard that
   lacks most, so the new sizes differ by little more than the smallest blocks.

Every row finds its new shard by joining with that plan, which is bounded by the parameters
and so may be broadcast. The law kept is ``bytes``: sizes near equal.

A shard is a folder ``shard=N`` of Parquet files whose rows have a ``slot``: blocks one after the other, and rows in order
within a block. ``lay_out`` writes documents as old shards, with the one shuffle that there is. ``rewrite`` reads the shards that
take part in a transfer and writes those that gain or lose a block again; a row's slot moves by what its block moves, so this
needs no shuffle. All other shards stay as they are. ``read`` reads the new shards from where they now lie.

Cases: a null text counts its fixed overhead only; a null key is a key; repeated rows share a
block and each have a slot, and a block is numbered by one task; an empty table gives no rows (and no transfers); other
columns pass through, but for those named ``shard`` or ``slot``, whose names are lengthened. Ties within a block are ordered by
key, then by the text's checksum.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepview.llm.shared import col, new_path, unused

SHARDS, BLOCKS, OVERHEAD = 24, 512, 8
#: Bytes of text that one task lays out, if they are of more than one block.
FILE = 64 << 20


@dataclass
class Plan:
    """Where each block goes, and what that means."""

    target: dict[tuple[int, int], int]
    rows: dict[tuple[int, int], int]
    flow: dict[tuple[int, int], int]
    moved: int = 0
    sizes: list[int] = field(default_factory=list)

    def affected(self) -> set[int]:
        """New shards whose files change."""
        return {s for (old, _), new in self.target.items() if old != new for s in (old, new)}


def capacities(sizes: list[int], shards: int) -> list[int]:
    """Equal shares of all bytes."""
    total = sum(sizes)
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one at least total cost; a byte that stays costs nothing, one that moves 1 unless ``cost`` says else.

    Successive shortest augmenting paths with potentials; nodes are shards only.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold all bytes")
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edges: to, residual, cost, index of the reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, (cost or {}).get((i, j), int(i != j)))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * len(graph)
    left = sum(supply)
    while left:
        reach: list[float] = [float("inf")] * len(graph)
        via: list[tuple[int, int] | None] = [None] * len(graph)
        reach[source], heap = 0, [(0, source)]
        while heap:
            far, a = heapq.heappop(heap)
            if far > reach[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                there = far + price + potential[a] - potential[b]
                if room and there < reach[b]:
                    reach[b], via[b] = there, (a, k)
                    heapq.heappush(heap, (there, b))
        potential = [p + (int(r) if r < float("inf") else 0) for p, r in zip(potential, reach, strict=True)]
        path, b = [], sink
        while b != source:
            a, k = via[b]
            path.append(graph[a][k])
            b = a
        sent = min(left, *(e[1] for e in path))
        for e in path:
            e[1] -= sent
            graph[e[0]][e[3]][1] += sent
        left -= sent
    # What a reverse edge can give back is what flows.
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def deal(blocks: dict[tuple[int, int], int], flow: dict[tuple[int, int], int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block): large blocks first, along the flow, to whom most is owed."""
    owed = defaultdict(dict)
    for (i, j), amount in flow.items():
        owed[i][j] = amount
    lacks = list(capacity)
    target = {}
    for (i, block), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        # What is owed along the edge decides, but never beyond what the shard itself still lacks.
        j = max(owed[i] or {i: 0}, key=lambda j: (min(owed[i].get(j, 0), lacks[j]), -j))
        target[i, block] = j
        owed[i][j] = owed[i].get(j, 0) - size
        lacks[j] -= size
    return target


def plan(sums: list[tuple[int, int, int, int]], old: int, shards: int = SHARDS, capacity: list[int] | None = None) -> Plan:
    """From (old shard, block, bytes, rows) of all blocks."""
    blocks = {(i, b): size for i, b, size, _ in sums}
    supply = [sum(s for (i, _), s in blocks.items() if i == k) for k in range(old)]
    capacity = capacity or capacities(supply, shards)
    flow = min_cost_flow(supply, capacity)
    made = Plan(deal(blocks, flow, capacity), {(i, b): n for i, b, _, n in sums}, flow)
    made.sizes = [0] * len(capacity)
    for at, j in made.target.items():
        made.sizes[j] += blocks[at]
        made.moved += blocks[at] * (at[0] != j)
    return made


def block_of(key: Column, text: Column, blocks: int = BLOCKS) -> Column:
    """Number of a row's block within its old shard."""
    return F.pmod(F.xxhash64(key, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(blocks)).cast("int")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def block_sums(docs: DataFrame, old_shard: Column, key: str, text: str) -> list[tuple[int, int, int, int]]:
    """Old shard, block, bytes and rows of each block: at most ``BLOCKS`` for each old shard."""
    each = docs.select(old_shard.cast("int").alias("old"), block_of(col(key), col(text)).alias("block"), size_of(col(text)).alias("size"))
    return sorted(tuple(r) for r in each.groupBy("old", "block").agg(F.sum("size"), F.count(F.lit(1))).collect())


def offsets(sums: list[tuple[int, int, int, int]], target: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Slot of the first row of each block, in the old shards or in those of ``target``."""
    at, out = defaultdict(int), {}
    for old, block, _, rows in sums:
        shard = old if target is None else target[old, block]
        out[old, block] = at[shard]
        at[shard] += rows
    return out


def lay_out(docs: DataFrame, old_shard: Column, folder: str, key: str = "doc_id", text: str = "text") -> list[tuple[int, int, int, int]]:
    """Write ``docs`` below ``folder`` as old shards; their block sums."""
    sums = block_sums(docs, old_shard, key, text)
    first, rows, part, held = offsets(sums), [], 0, 0
    for old, block, size, _ in sums:
        if held and held + size > FILE:
            part, held = part + 1, 0
        held += size
        rows.append((old, block, part, first[old, block]))
    o, b, p, f, c, n = unused(docs, "_old", "_block", "_part", "_first", "_crc", "_slot")
    # At most old * BLOCKS rows of four numbers, whatever the data.
    where = F.broadcast(docs.sparkSession.createDataFrame(rows, "old int, block int, part int, first bigint").toDF(o, b, p, f))
    marked = docs.withColumns({o: old_shard.cast("int"), b: block_of(col(key), col(text)), c: _checksum(text)})
    # Ranges of blocks, as many bytes in each: a task writes few shards.
    dealt = marked.join(where, [o, b]).repartition(part + 1, p)
    order = Window.partitionBy(p, o, b).orderBy(col(key), c)
    slots = dealt.withColumn(n, (F.col(f) + F.row_number().over(order) - 1).cast("bigint"))
    out = slots.select(*_carried(docs), F.col(b).alias("block"), F.col(n).alias("slot"), F.col(o).alias("shard"))
    out.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return sums


def _carried(docs: DataFrame) -> list[Column]:
    """All columns; those with a name that shards need themselves get another."""
    taken = ("shard", "slot", "block")
    return [col(c).alias(unused(docs, c)[0] if c.lower() in taken else c) for c in docs.columns]


def _checksum(text: str) -> Column:
    return F.crc32(F.coalesce(col(text), F.lit("")).cast("binary"))


def rewrite(spark: SparkSession, folder: str, sums: list[tuple[int, int, int, int]], old: int, into: str, shards: int = SHARDS) -> Plan:
    """Write the new shards that gain or lose a block, from the old ones in ``folder``, below ``into``."""
    made = plan(sums, old, shards)
    before, after = offsets(sums), offsets(sums, made.target)
    affected = made.affected()
    moves = [(*at, s, after[at] - before[at]) for at, s in sorted(made.target.items()) if s in affected]
    where = spark.createDataFrame(moves, "shard int, block int, new int, shift bigint")
    stored = spark.read.parquet(folder).where(F.col("shard").isin(sorted({m[0] for m in moves}) or [-1])) if sums else None
    if stored is None or not moves:
        return made
    moved = stored.join(F.broadcast(where), ["shard", "block"])
    columns = [c for c in stored.columns if c not in ("slot", "block", "shard")]
    out = moved.select(*map(col, columns), "block", (F.col("slot") + F.col("shift")).alias("slot"), F.col("shard").alias("old_shard"), F.col("new").alias("shard"))
    out.write.option("compression", "zstd").partitionBy("shard").parquet(into)
    return made


def read(spark: SparkSession, folder: str, made: Plan, into: str) -> DataFrame:
    """All rows of the new shards: written again below ``into``, or untouched in ``folder``; with their ``old_shard``."""
    affected = sorted(made.affected())
    kept = spark.read.parquet(folder).withColumn("old_shard", F.col("shard"))
    if not affected:
        return kept
    return kept.where(~F.col("shard").isin(affected)).unionByName(spark.read.parquet(into))


def resharded(docs: DataFrame, old_shard: Column, old: int, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Documents laid out as old shards, resharded, and read back from the files: size, checksum, shard and slot of each row."""
    spark = docs.sparkSession
    folder, into = new_path(spark, "old-shards"), new_path(spark, "new-shards")
    sums = lay_out(docs.select(col(key).alias("doc_id"), col(text).alias("text"), old_shard.cast("int").alias("origin")), F.col("origin"), folder)
    if not sums:
        rows = spark.createDataFrame([], docs.select(col(key).alias("doc_id"), col(text).alias("text")).schema)
        rows = rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint"), "old_shard": F.lit(0)})
    else:
        rows = read(spark, folder, rewrite(spark, folder, sums, old, into, shards), into)
    return rows.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        _checksum("text").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
