"""Secret scans with multipart credential linking.

Three strong kinds are always reported: assignments of named secrets, access
identifiers with a known prefix, long hexadecimal strings. Three weak kinds are
parts of a credential that say little alone: ``id`` (users, accounts, addresses),
``key`` (other assignments, long random-looking strings) and ``endpoint``. An
interval join within scopes (parts of a text between blank lines) links parts
at most ``REACH`` code points apart: a weak identifier is reported beside a secret,
a weak key beside an identifier, an endpoint beside both. A weak part that overlaps
a strong one is not reported again.

Everything is DataFrame expressions. Positions come from the pieces between
matches, summed up in windows over the (few) matches of a text. The join is two
windows over the parts of a scope in order: the furthest end of each kind before,
and the nearest start behind, decide it without any pair being formed.

Cases: a null text is empty; a null id is an id like any other; repeated rows each
get the spans of their text; an empty table gives none; other columns are not read, and
``redacted`` passes them through. Equal starts are ordered by kind. A text is one
row, however long; its matches are one window.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepview.llm.shared import col, saved, unused

#: Code points between parts that belong together.
REACH = 400
#: Kinds in their order, strong ones first.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = 3

#: Pattern of each kind, the group whose length counts, and its least length.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
    "id": (r"""((?i:user|user_?name|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+)""", 1, 3),
    "key": (r"""((?i:pwd|pass|passphrase|private_?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9+/]{40,})""", 1, 6),
    "endpoint": (r"""((?:https?|ftp|ssh|postgres|postgresql|mysql|redis|amqp)://[^\x00-\x20"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,})""", 1, 3),
}
#: A blank line ends a scope.
BREAK = r"(\n\x20*\n)"
#: Whatever can be reported holds one of these.
MAY = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", PATTERNS["key"][0])


def may_hold(text: Column) -> Column:
    """False only for texts without any span."""
    return functools.reduce(Column.__or__, [F.coalesce(text.rlike(p), F.lit(False)) for p in MAY])


def _matches(text: Column, rank: int, pattern: str, group: int) -> Column:
    """Per match of a text: kind, place in the row, length of the piece before, of the match, and of the group that counts."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    counted = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    # Zipped, so that each of them is worked out once and not for every match.
    rows = F.slice(F.arrays_zip(whole.alias("m"), F.split(text, pattern).alias("gap"), counted.alias("counted")), 1, F.size(whole))
    return F.transform(
        rows,
        lambda r, i: F.struct(
            F.lit(rank).alias("rank"),
            i.cast("int").alias("i"),
            F.length(r["gap"]).cast("bigint").alias("gap"),
            F.length(r["m"]).cast("bigint").alias("size"),
            F.length(r["counted"]).alias("counted"),
        ),
    )


def extracted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id``, ``h`` (of the text) and the ``matches`` of all kinds and of scopes' ends; written, as it is used twice."""
    body = F.coalesce(col(text), F.lit(""))
    plain = docs.select(col(key).alias("doc_id"), body.alias("text")).withColumn("may", may_hold(F.col("text")))
    kinds = [_matches(F.col("text"), i, *PATTERNS[k][:2]) for i, k in enumerate(KINDS)]
    found = F.concat(*kinds, _matches(F.col("text"), len(KINDS), BREAK, 1))
    h = F.concat(F.hex(F.xxhash64("text")), F.hex(F.hash("text")))
    return saved(plain.select("doc_id", h.alias("h"), F.when(F.col("may"), found).alias("matches")), "matches")


def linked(matches: DataFrame) -> DataFrame:
    """Spans to report: ``doc_id``, ``h``, ``rank`` of the kind, ``start``, ``end`` (code points, end exclusive)."""
    each = matches.where("matches IS NOT NULL").select("doc_id", "h", F.inline("matches")).distinct()
    row = Window.partitionBy("doc_id", "h", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.get(F.array(*[F.lit(PATTERNS[k][2]) for k in KINDS], F.lit(0)), F.col("rank"))
    end = F.sum(F.col("gap") + F.col("size")).over(row)
    parts = each.withColumn("end", end).where(F.col("counted") >= least).withColumn("start", F.col("end") - F.col("size"))
    order = ("start", "end", "rank")
    document = Window.partitionBy("doc_id", "h").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("scope", F.sum((F.col("rank") == len(KINDS)).cast("int")).over(document)).where(F.col("rank") < len(KINDS))
    before = Window.partitionBy("doc_id", "h", "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("doc_id", "h", "scope").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    sets = {"strong": (0, 1, 2), "ids": (1, 3), "secrets": (0, 2, 4)}
    for name, ranks in sets.items():
        among = F.col("rank").isin(*ranks)
        parts = parts.withColumn(f"{name}_end", F.max(F.when(among, F.col("end"))).over(before))
        parts = parts.withColumn(f"{name}_start", F.min(F.when(among, F.col("start"))).over(behind))

    def near(name: str) -> Column:
        within = (F.col("start") - F.col(f"{name}_end") <= REACH, F.col(f"{name}_start") - F.col("end") <= REACH)
        return F.coalesce(within[0], F.lit(False)) | F.coalesce(within[1], F.lit(False))

    overlaps = F.coalesce(F.col("strong_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_start") < F.col("end"), F.lit(False))
    rank = F.col("rank")
    weak = (
        F.when(rank == 3, near("secrets")).when(rank == 4, near("ids")).otherwise(near("ids") & near("secrets"))
    )
    return parts.where((rank < STRONG) | (~overlaps & weak)).select("doc_id", "h", "rank", "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    written = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(written, ","), F.lit(""))


def _is(rank: int) -> Callable[[Column], Column]:
    return lambda x: x == rank


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the strong kinds, hash of their spans, and all spans."""
    matches = extracted(docs, key, text)
    span = F.struct("start", "rank", "end")
    spans = saved(linked(matches).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(span)).alias("spans")), "spans")
    same = matches["doc_id"].eqNullSafe(spans["doc_id"]) & (matches["h"] == spans["h"])
    each = matches.join(spans, same, "left").select(matches["doc_id"], F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, _is(i))).cast("bigint").alias(f"n_{KINDS[i]}") for i in range(STRONG)]
    strong = _joined(F.filter("spans", lambda s: s["rank"] < STRONG))
    linked_parts = F.size(F.filter("spans", lambda s: s["rank"] >= STRONG)).cast("bigint")
    return each.select("doc_id", *counts, F.sha2(strong.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), linked_parts.alias("n_linked"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; ``n_chars``, where there is one, follows.

    Only rows that may hold a span are joined with the spans; all others pass by.
    """
    matches = extracted(docs, key, text)
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Overlapping spans become one: a new one begins where all before have ended.
    spans = linked(matches).withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = spans.groupBy("doc_id", "h", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    k, h, at, mine = unused(docs, "_key", "_h", "_cuts", "_text_h")
    gathered = cuts.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(at))
    gathered = saved(gathered.withColumnsRenamed({"doc_id": k, "h": h}), "cuts")
    body, cut = col(text), F.col(at)
    hashed = docs.where(may_hold(body)).withColumn(mine, F.concat(F.hex(F.xxhash64(body)), F.hex(F.hash(body))))
    joined = hashed.join(gathered, col(key).eqNullSafe(F.col(k)) & (F.col(mine) == F.col(h)), "left")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"])
    piece = F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda i: F.substring(body, (begin(i) + 1).cast("int"), (F.coalesce(F.get(cut, i)["start"], F.length(body)) - begin(i)).cast("int")),
    )
    changed = F.when(cut.isNull(), body).otherwise(F.array_join(piece, mark))
    columns = [changed.alias(c) if c == text else col(c) for c in docs.columns]
    out = joined.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(col(text)).cast(docs.schema["n_chars"].dataType))
    return docs.where(~may_hold(body)).select(*map(col, docs.columns)).unionByName(out.select(*map(col, docs.columns)))


def _sql() -> str:
    parts = []
    for i, (pattern, group, _) in enumerate([*PATTERNS.values(), (BREAK, 1, 0)]):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS rank, generate_subscripts(whole, 1) AS i, unnest(whole) AS m, unnest(before[1:len(whole)]) AS gap, unnest(counted) AS counted"
            f" FROM (SELECT doc_id, regexp_extract_all(text, '({quoted})', 1) AS whole, regexp_extract_all(text, '({quoted})', {group + 1}) AS counted,"
            f" string_split_regex(text, '{quoted}') AS before FROM d)"
        )
    least = ", ".join(str(p[2]) for p in PATTERNS.values())
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    near = "(coalesce(p.start - {0}_end <= {1}, false) OR coalesce({0}_start - p.end_ <= {1}, false))"
    ids, secrets = near.format("ids", REACH), near.format("secrets", REACH)
    over = "PARTITION BY doc_id, scope ORDER BY start, end_, rank ROWS BETWEEN"
    around = ", ".join(
        f"max(end_) FILTER (rank IN ({r})) OVER ({over} UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}_end, min(start) FILTER (rank IN ({r})) OVER ({over} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {n}_start"
        for n, r in (("strong", "0, 1, 2"), ("ids", "1, 3"), ("secrets", "0, 2, 4"))
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
each AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT doc_id, rank, length(m) AS size, length(counted) AS counted, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS end_ FROM each),
parts AS (SELECT doc_id, rank, end_ - size AS start, end_ FROM placed WHERE counted >= [{least}, 0][rank + 1]),
scoped AS (SELECT *, sum(CASE WHEN rank = {len(KINDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, end_, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM parts),
p AS (SELECT *, {around} FROM scoped WHERE rank < {len(KINDS)}),
spans AS (SELECT doc_id, rank, start, [{kinds}][rank + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(end_ AS BIGINT) AS s FROM p WHERE rank < {STRONG} OR (
  NOT coalesce(strong_end > start, false) AND NOT coalesce(strong_start < end_, false)
  AND CASE rank WHEN 3 THEN {secrets} WHEN 4 THEN {ids} ELSE {ids} AND {secrets} END))
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {STRONG}), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans, count(*) FILTER (rank >= {STRONG}) AS n_linked
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
