"""Quality-control images: classification, drill-down tree, defaults and lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepview.functions import nested, paths
from stepview.functions.natural import natural_key
from stepview.operators.prefix import prefix_join
from stepview.operators.ranking import materialize, rank

ROOT = ["source", "participant", "root"]
SET = [*ROOT, "set_name"]
BIT = [*SET, "bit"]


def qc_files(manifest: DataFrame) -> DataFrame:
    """Files anywhere below ``quality_control/``; ``rel_path`` starts below it."""
    folder = "quality_control/"
    return manifest.where(~F.col("is_dir") & F.col("rel_path").startswith(folder)).select(
        "source", F.substring("rel_path", len(folder) + 1, 1 << 30).alias("rel_path"), "path"
    )


def _reject_reason(rel_path: Column) -> Column:
    return F.when(~F.contains(rel_path, F.lit("/")), "too_shallow").when(
        ~rel_path.rlike("^[^/]*/set"), "outside_set"
    )


def qc_rejects(files: DataFrame) -> DataFrame:
    """How many files of each source fall outside ``root/set*/``, and why."""
    return (
        files.select("source", _reject_reason(F.col("rel_path")).alias("reason"))
        .where("reason is not null")
        .groupBy("source", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classified(files: DataFrame, participants: DataFrame, longest: bool = False) -> DataFrame:
    """Each image under each participant it belongs to, classified, unranked.

    ``_nat`` holds the natural key of the path. ``bit`` is what a drill-down
    names: the stem of a group, or the file name of any other image.
    """
    path = F.col("rel_path")
    kept = files.where(_reject_reason(path).isNull()).select("source", "rel_path")
    named = kept.withColumn("name", paths.base_name(path))
    matched = prefix_join(named, participants, by=["source"], longest=longest)
    name, kind = F.col("name"), F.col("item_kind")
    kinds = (
        F.when(name.contains("-badChan-scalp") & name.rlike(paths.SCALP_PATTERN), "scalp")
        .when(name.contains("-chs") & name.rlike(paths.CHANNELS_PATTERN), "chs")
        .otherwise("rest")
    )

    def from_channels(group: int) -> Column:
        return F.when(kind == "chs", F.regexp_extract(name, paths.CHANNELS_PATTERN, group))

    stem = F.when(kind == "scalp", F.regexp_extract(name, paths.SCALP_PATTERN, 1)).otherwise(from_channels(1))
    # In steps, so that an expression used further up is not worked out again.
    return (
        matched.withColumn("item_kind", kinds)
        .withColumn("stem", stem)
        .select(
            "source",
            "participant",
            F.substring_index("rel_path", "/", 1).alias("root"),
            F.substring_index(F.substring_index("rel_path", "/", 2), "/", -1).alias("set_name"),
            "item_kind",
            "stem",
            from_channels(2).try_cast("bigint").alias("ch_start"),
            from_channels(3).try_cast("bigint").alias("ch_end"),
            "name",
            "rel_path",
            F.coalesce("stem", "name").alias("bit"),
            natural_key(path).alias("_nat"),
        )
    )


def qc_items(files: DataFrame, participants: DataFrame, longest: bool = False) -> DataFrame:
    """One row per participant and image, with its position in natural order."""
    items = classified(files, participants, longest)
    ranked = rank(items, ["source", "participant"], ["_nat", "rel_path"], "nat_rank")
    return ranked.drop("bit", "_nat")


def _is_rest() -> Column:
    return F.col("item_kind") == "rest"


def _last(kind: str) -> Column:
    """The image of ``kind`` that is last in natural order."""
    return F.max(F.when(F.col("item_kind") == kind, F.struct("_nat", "rel_path", "name")))


def qc_tree(items: DataFrame) -> DataFrame:
    """The drill-down, one row per image shown: ``SET, is_rest, bit, item_kind, pos, rel_path, ch_start, ch_end``.

    Takes ``classified`` rows. A group (``is_rest`` false) shows its last scalp
    image and all channel-range images, with their position ``pos`` by (start,
    end, name, path); any other bit the last image of its name.
    """
    keys = [*SET, "is_rest", "bit", "item_kind"]
    items = items.withColumn("is_rest", _is_rest())
    order = ["ch_start", "ch_end", "name", "rel_path"]
    is_range = F.col("item_kind") == "chs"
    # All kinds are ranked, not the ranges alone, so that ``items`` is worked out once.
    ranked = rank(items, keys, order, "pos")
    ranges = ranked.where(is_range).select(*keys, "pos", "rel_path", "ch_start", "ch_end")
    last = ranked.where(~is_range).groupBy(*keys).agg(F.max(F.struct("_nat", "rel_path")).alias("_last"))
    none = F.lit(None).cast("bigint")
    single = last.select(*keys, F.lit(1).cast("bigint").alias("pos"), "_last.rel_path", none.alias("ch_start"), none.alias("ch_end"))
    return ranges.unionByName(single)


def qc_defaults(items: DataFrame) -> DataFrame:
    """Each root's first set and the bit shown first in it.

    That bit is the first other image if there is one, else the first group.
    Takes ``classified`` rows. They are written out first: grouped as they come
    from the prefix join, all sets of a participant would stay in one task.
    """
    return _defaults(materialize(items, "items"))


def _defaults(items: DataFrame) -> DataFrame:
    at = F.struct("_nat", "rel_path")
    per_set = items.groupBy(*SET).agg(
        F.min(at).alias("_first"),
        F.min(F.when(_is_rest(), F.struct("_nat", "rel_path", "bit"))).alias("_rest"),
        F.min(F.when(~_is_rest(), F.struct("_nat", "rel_path", "bit"))).alias("_group"),
    )
    return per_set.select(*SET, "_first", F.coalesce("_rest.bit", "_group.bit").alias("bit"))


def first_sets(per_set: DataFrame) -> DataFrame:
    """Of ``qc_defaults`` rows, the one of each root's first set."""
    return (
        per_set.groupBy(*ROOT)
        .agg(F.min(F.struct("_first", "set_name", "bit")).alias("_at"))
        .select(*ROOT, F.col("_at.set_name").alias("set_name"), F.col("_at.bit").alias("bit"))
    )


def _bits(items: DataFrame) -> DataFrame:
    """One row per bit: ``qc_type`` and the one image it shows besides ranges, if any.

    Where a group and another image share a bit, the group wins.
    """
    grouped = F.col("_grouped")
    return (
        items.groupBy(*BIT)
        .agg(F.max(~_is_rest()).alias("_grouped"), _last("scalp").alias("_scalp"), _last("rest").alias("_rest"))
        .select(
            *BIT,
            F.when(grouped, "eeg").otherwise("image").alias("qc_type"),
            F.when(grouped, F.col("_scalp.rel_path")).otherwise(F.col("_rest.rel_path")).alias("rel_path"),
        )
    )


def qc_lookup(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Answer ``requests(request, source, participant, root, set_name, bit)``.

    A missing set or bit takes its default. ``status`` is ``eeg`` or ``image``
    (one row per image), ``not_found`` if both set and bit were given and
    nothing is there, ``empty`` or, without a root, ``unselected``.
    """
    # Written out as they are used more than once, and so that the lookups below
    # are joins of two shuffles, in which AQE can split a much requested key.
    items = materialize(items, "items")
    per_set = materialize(_defaults(items), "defaults")
    bits = materialize(_bits(items), "bits")
    sets = first_sets(per_set).select(*ROOT, F.col("set_name").alias("_set"))
    first = per_set.select(*SET, F.col("bit").alias("_bit"))
    both = F.col("set_name").isNotNull() & F.col("bit").isNotNull()
    status = (
        F.when(F.coalesce("root", F.lit("")) == "", "unselected")
        .when(F.col("qc_type").isNotNull(), F.col("qc_type"))
        .when(F.col("_both"), "not_found")
        .otherwise("empty")
    )
    asked = (
        requests.withColumn("_both", both)
        .join(materialize(sets, "sets"), ROOT, "left")
        .withColumn("set_name", F.coalesce("set_name", "_set"))
        .join(first, SET, "left")
        .withColumn("bit", F.coalesce("bit", "_bit"))
        .join(bits, BIT, "left")
        .select("request", *BIT, status.alias("status"), "qc_type", "rel_path")
    )
    asked = materialize(asked, "asked")
    # A bit without ranges has its one row already, one with ranges may have one more.
    single = asked.where("rel_path is not null or qc_type is null").select("request", "status", "rel_path")
    ranges = items.where("item_kind = 'chs'").select(*BIT, F.col("rel_path").alias("_range"))
    # An inner join can be split on both sides, were a bit's images many.
    several = asked.where("qc_type = 'eeg'").join(ranges, BIT).select("request", "status", F.col("_range").alias("rel_path"))
    return single.unionByName(several)


def with_encoded(items: DataFrame, encoded: DataFrame) -> DataFrame:
    """``items`` with the encoded image content instead of the path alone.

    ``encoded`` is ``source, rel_path, encoded``; other columns stay as they are.
    """
    return items.join(encoded.select("source", "rel_path", "encoded"), ["source", "rel_path"], "left")


def nested_sets(tree: DataFrame) -> DataFrame:
    """The drill-down of each set as one nested value: ``SET``, ``groups`` and ``rest``.

    Takes ``qc_tree`` rows. ``groups`` maps a stem to its ``scalp`` image (``name, rel_path``; NULL without one) and its ranges
    ``chs`` (``ch_start, ch_end, name, rel_path``) in order, ``rest`` a file name to its path. One set of one participant is
    brought together in one row: for what is shown at once, not for a whole source's images.
    """
    name = paths.base_name(F.col("rel_path"))
    shown = tree.withColumn("name", name)
    scalp = F.max(F.when(F.col("item_kind") == "scalp", F.struct("name", "rel_path")))
    ranges = F.collect_list(F.when(F.col("item_kind") == "chs", F.struct("pos", "ch_start", "ch_end", "name", "rel_path")))
    chs = F.transform(F.array_sort(ranges), lambda r: r.dropFields("pos"))
    bits = shown.groupBy(*SET, "is_rest", "bit").agg(scalp.alias("scalp"), chs.alias("chs"), F.max("rel_path").alias("rel_path"))
    return _sets(bits)


def nested_items(items: DataFrame) -> DataFrame:
    """The same from ``classified`` rows: no positions are needed where the images of a set are brought together anyway."""
    # Written first: grouped as they come from the prefix join, all sets of a participant would stay in one task.
    items = materialize(items.withColumn("is_rest", _is_rest()), "items")
    order = ("ch_start", "ch_end", "name", "rel_path")
    ranges = F.collect_list(F.when(F.col("item_kind") == "chs", F.struct(*order)))
    bits = items.groupBy(*SET, "is_rest", "bit").agg(_last("scalp").alias("_scalp"), ranges.alias("chs"), _last("rest").alias("_rest"))
    scalp = F.when(F.col("_scalp").isNotNull(), F.struct(F.col("_scalp.name").alias("name"), F.col("_scalp.rel_path").alias("rel_path")))
    return _sets(bits.select(*SET, "is_rest", "bit", scalp.alias("scalp"), F.array_sort("chs").alias("chs"), F.col("_rest.rel_path").alias("rel_path")))


def _sets(bits: DataFrame) -> DataFrame:
    group = F.when(~F.col("is_rest"), F.struct("bit", F.struct("scalp", "chs")))
    other = F.when(F.col("is_rest"), F.struct("bit", "rel_path"))
    sets = bits.groupBy(*SET).agg(F.collect_list(group).alias("groups"), F.collect_list(other).alias("rest"))
    return sets.select(*SET, F.map_from_entries("groups").alias("groups"), F.map_from_entries("rest").alias("rest"))


def encode_nested(rows: DataFrame, columns: list[str], encoded: DataFrame, keys: list[str], names: tuple[str, ...] = ("rel_path", "rest")) -> DataFrame:
    """``rows`` with each path nested anywhere in ``columns`` replaced by its content.

    ``encoded`` is ``keys, rel_path, encoded``. Paths are the texts in or below fields of the given ``names``, at any
    depth; other values stay. One without content becomes NULL. The paths of all columns are looked up in one join.
    """
    # Written first: the number of a row must not change between its two uses.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "nested")
    whole = F.struct(*[F.col(c) for c in columns])
    kind = rows.select(*columns).schema
    wanted = rows.select("_row", *keys, F.explode(F.array_distinct(nested.texts(whole, kind, names))).alias("rel_path"))
    known = wanted.join(encoded.select(*keys, "rel_path", "encoded"), [*keys, "rel_path"])
    known = known.groupBy("_row").agg(F.collect_list(F.struct("rel_path", "encoded")).alias("_known"))
    both = rows.join(known, "_row", "left").drop("_row")
    n = len(both.columns) - 1
    schema = T.StructType(both.schema.fields[:n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tables = [dict(zip(*map(pa.Array.to_pylist, x.values.flatten()))) if x.is_valid else {} for x in part.column(n)]
                out = []
                for field, value in zip(schema.fields, part.columns[:n], strict=True):
                    if field.name in columns:
                        value = nested.replaced(value, field.dataType, names, np.arange(len(value)), tables, field.name in names)
                    out.append(value)
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return both.toDF(*[f"c{i}" for i in range(n + 1)]).mapInArrow(run, schema)
