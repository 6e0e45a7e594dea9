"""Steps and participants of every source at once.

``step_files(source, participant, step_num, step_dir)`` has one row per
recording file; the other relations here are built on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepview.functions import paths
from stepview.functions.natural import natural_key
from stepview.operators.prefix import prefix_join
from stepview.operators.ranking import materialize, rank, spread

PARTICIPANT = ["source", "participant"]


def step_files(manifest: DataFrame) -> DataFrame:
    """Recordings directly inside a numbered first-level directory."""
    path = F.col("rel_path")
    step_dir = F.substring_index(path, "/", 1)
    return manifest.where(path.rlike(paths.RECORDING_PATH)).select(
        "source",
        paths.recording_stem(F.substring_index(path, "/", -1)).alias("participant"),
        F.substring_index(step_dir, "_", 1).try_cast("bigint").alias("step_num"),
        step_dir.alias("step_dir"),
    )


def participants(files: DataFrame) -> DataFrame:
    """Recording files per participant, most first; files, not distinct steps."""
    return (
        files.groupBy(*PARTICIPANT)
        .agg(F.count(F.lit(1)).alias("n_files"))
        .orderBy("source", F.desc("n_files"), "participant")
    )


def step_dirs(manifest: DataFrame) -> DataFrame:
    """Numbered first-level directories, with or without files in them."""
    name = F.col("rel_path")
    number = paths.step_number(name)
    top = manifest.where(F.col("is_dir") & ~F.contains(name, F.lit("/")))
    return top.where(number.isNotNull()).select("source", number.alias("step_num"), name.alias("step_dir"))


def step_rejects(names: DataFrame) -> DataFrame:
    """Of ``names(source, name, is_dir)``, what looks like a step but is none, and why."""
    reason = F.when(
        ~F.col("is_dir") & F.col("name").rlike(r"^\p{N}"), "not_a_directory"
    ).otherwise(paths.step_reject_reason(F.col("name")))
    return names.select("source", "name", reason.alias("reason")).where("reason is not null")


def steps(dirs: DataFrame) -> DataFrame:
    """Every source's steps by number, then directory in code-point order."""
    return dirs.select("source", "step_num", "step_dir").distinct().orderBy("source", "step_num", "step_dir")


def steps_of(dirs: DataFrame, files: DataFrame, participant: str) -> DataFrame:
    """Steps whose directory holds the file of one participant."""
    own = files.where(F.col("participant") == participant)
    return (
        dirs.join(own, ["source", "step_dir"], "left_semi")
        .select("source", "step_num", "step_dir")
        .orderBy("source", "step_num", natural_key(F.col("step_dir")), "step_dir")
    )


def steps_for_participants(files: DataFrame) -> DataFrame:
    """``steps_of`` for all participants, with the position ``pos`` in natural order.

    A file's own path already names its step, so no join with the steps is needed.
    """
    keyed = files.withColumn("_nat", natural_key(F.col("step_dir")))
    return rank(keyed, PARTICIPANT, ["step_num", "_nat", "step_dir"], "pos").drop("_nat")


def latest_dirs(files: DataFrame) -> DataFrame:
    """One directory per step number: the last in natural order."""
    return (
        files.groupBy(*PARTICIPANT, "step_num")
        .agg(F.max(F.struct(natural_key(F.col("step_dir")).alias("nat"), "step_dir")).alias("_last"))
        .select(*PARTICIPANT, "step_num", F.col("_last.step_dir").alias("step_dir"))
    )


def _with_shifted(files: DataFrame, *carried: str) -> DataFrame:
    """Each row twice: under its own step and, with ``own`` false, under the next.

    Grouping the result replaces the self-join on ``step_num - 1``: one scan,
    one shuffle. Only files that are alike but for their directory's name share
    a key, so nothing is combined in front of it.
    """
    num = F.col("step_num")
    marks = F.array(
        F.struct(num.alias("step_num"), F.lit(True).alias("own")),
        F.struct(F.try_add(num, F.lit(1)).alias("step_num"), F.lit(False).alias("own")),
    )
    both = files.select(*PARTICIPANT, *carried, F.explode(marks).alias("_at")).select(
        *PARTICIPANT, *carried, "_at.step_num", "_at.own"
    )
    return spread(both, *PARTICIPANT, "step_num")


def with_previous(files: DataFrame) -> DataFrame:
    """Each participant's steps and whether the step numbered one less exists too."""
    return (
        _with_shifted(files)
        .groupBy(*PARTICIPANT, "step_num")
        .agg(F.max("own").alias("_own"), F.max(~F.col("own")).alias("has_prev"))
        .where("_own")
        .select(*PARTICIPANT, "step_num", "has_prev")
    )


def resolved_steps(files: DataFrame) -> DataFrame:
    """Each step's directory and its predecessor's, duplicates settled as in ``latest_dirs``.

    ``present`` (BOOLEAN) may be among the input's columns: whether the file is
    still there. It is carried along for both.
    """
    if "present" not in files.columns:
        files = files.withColumn("present", F.lit(True))
    named = F.struct(natural_key(F.col("step_dir")).alias("nat"), "step_dir", "present")
    return (
        _with_shifted(files, "step_dir", "present")
        .groupBy(*PARTICIPANT, "step_num")
        .agg(
            F.max(F.when(F.col("own"), named)).alias("_this"),
            F.max(F.when(~F.col("own"), named)).alias("_prev"),
        )
        .where("_this is not null")
        .select(
            *PARTICIPANT,
            "step_num",
            F.col("_this.step_dir").alias("step_dir"),
            F.col("_this.present").alias("present"),
            F.col("_prev.step_dir").alias("prev_dir"),
            F.col("_prev.present").alias("prev_present"),
        )
    )


def wants_overlay(has_prev: Column, asked: Column) -> Column:
    return has_prev & F.coalesce(asked == "onionskin", F.lit(False))


def step_lookup(requests: DataFrame, files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Answer ``requests(request, source, participant, step_text, overlay_text)``.

    ``status`` is ``unselected`` (no step asked for), ``bad_step`` (not an
    integer), ``no_step``, ``no_file`` or ``ok``. ``present`` lists the
    files there are now, where ``files`` is an older catalogue.
    """
    if present is not None:
        keys = [*PARTICIPANT, "step_dir"]
        here = spread(present.select(*keys), *keys).distinct().withColumn("_here", F.lit(True))
        files = spread(files, *keys).join(here, keys, "left").select(
            *PARTICIPANT, "step_num", "step_dir", F.coalesce("_here", F.lit(False)).alias("present")
        )
    asked = requests.withColumn("step_num", paths.text_to_int(F.col("step_text")))
    # Written out so that AQE can split a step that is asked for very often.
    resolved = materialize(resolved_steps(files), "resolved")
    found = asked.join(resolved, [*PARTICIPANT, "step_num"], "left")
    exists = F.col("step_dir").isNotNull()
    has_prev = exists & F.col("prev_dir").isNotNull()
    overlay = wants_overlay(has_prev, F.col("overlay_text"))
    gone = ~F.col("present") | (overlay & ~F.col("prev_present"))
    status = (
        F.when(F.coalesce("step_text", F.lit("")) == "", "unselected")
        .when(F.col("step_num").isNull(), "bad_step")
        .when(~exists, "no_step")
        .when(gone, "no_file")
        .otherwise("ok")
    )
    return found.select(
        "request",
        status.alias("status"),
        F.when(status == "ok", has_prev).otherwise(False).alias("has_prev"),
        F.when(status == "ok", overlay).otherwise(False).alias("overlay"),
    )


def overview(people: DataFrame, files: DataFrame, qc: DataFrame, logs: DataFrame) -> DataFrame:
    """Steps, QC images and logs of every participant, as ``(section, item)`` rows.

    ``qc`` and ``logs`` have ``source, name, rel_path``.
    """
    people = materialize(people.select(*PARTICIPANT).distinct(), "people")
    own_steps = files.join(people, PARTICIPANT, "left_semi").select(
        *PARTICIPANT, F.lit("step").alias("section"), F.col("step_dir").alias("item")
    )
    listed = qc.select("source", "name", F.lit("qc").alias("section"), F.col("rel_path").alias("item")).unionByName(
        logs.select("source", "name", F.lit("log").alias("section"), F.col("rel_path").alias("item"))
    )
    matched = prefix_join(listed, people, by=["source"])
    return own_steps.unionByName(matched.select(*PARTICIPANT, "section", "item"))
