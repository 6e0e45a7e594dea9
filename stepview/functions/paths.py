"""Path and text parsing as built-in column expressions.

Every function takes and returns a ``Column``, so a filter written with them
stays inside the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two image-name patterns, anchored at the start only and
# with an unescaped dot before "png", as the image names are matched today.
SCALP_PATTERN = r"^([^-]+)-badChan-scalp.png"
CHANNELS_PATTERN = r"^(.+)-chs([0-9]+)-([0-9]+).png"

# Suffixes of a recording and of its two converted copies.
RECORDING_SUFFIX = ".set"
RAW_COPY_ENDING = "-raw.fif"
EPOCHS_COPY_ENDING = "-epo.fif"

NUMBERED_PATTERN = r"^[0-9]+\s*(_|$)"
# A step number fits into BIGINT: 18 digits at most, leading zeros aside.
_STEP = r"^0*[0-9]{1,18}\s*"
STEP_PATTERN = _STEP + r"(_|$)"
# Files in a step directory, told by one pattern over the whole path so that a
# scan evaluates it once per file: a recording (its name is more than a suffix)
# and the hidden copy of one.
_RECORDING = r"\.*[^./][^/]*\.set"
RECORDING_PATH = _STEP + rf"(_[^/]*)?/{_RECORDING}$"
RECORDING_OR_COPY_PATH = _STEP + rf"(_[^/]*)?/({_RECORDING}|\.[^/]+-(raw|epo)\.fif)$"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def is_numbered(name: Column) -> Column:
    """Is this the name of a step directory: ASCII digits, then ``_`` or the end?"""
    return name.rlike(NUMBERED_PATTERN)


def step_number(name: Column) -> Column:
    """The number in front of the first ``_``; NULL if the name is no step name."""
    return F.when(name.rlike(STEP_PATTERN), F.substring_index(name, "_", 1).try_cast("bigint"))


def step_reject_reason(name: Column) -> Column:
    """Why a name that starts with a numeric character is not a step; else NULL."""
    return (
        F.when(is_numbered(name) & step_number(name).isNull(), "number_too_large")
        .when(is_numbered(name), F.lit(None).cast("string"))
        .when(name.rlike(r"^[0-9]"), "not_a_number")
        .when(name.rlike(r"^\p{N}"), "not_ascii")
    )


def text_to_int(text: Column) -> Column:
    """Integer in ``text`` (sign, blanks around and single ``_`` allowed), else NULL."""
    bare = F.regexp_replace(text, r"[_\s]", "")
    return F.when(text.rlike(INTEGER_PATTERN), bare.try_cast("bigint"))


def suffix(name: Column) -> Column:
    """Last suffix with its dot; ``''`` if there is none (``.set`` has none)."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """Name without its last suffix."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def is_recording(name: Column) -> Column:
    """Is ``.set`` the suffix of ``name``? Plain string tests, for use on every file."""
    return name.endswith(RECORDING_SUFFIX) & (F.ltrim(recording_stem(name), F.lit(".")) != "")


def recording_stem(name: Column) -> Column:
    """``stem`` of a name that is known to end in ``.set``."""
    return F.substring(name, F.lit(1), F.length(name) - len(RECORDING_SUFFIX))


def parts(rel_path: Column) -> Column:
    return F.split(rel_path, "/")


def base_name(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1)


def parent(rel_path: Column) -> Column:
    """Path without its last segment; ``''`` at the top level."""
    size = F.length(rel_path) - F.length(base_name(rel_path)) - 1
    return F.substring(rel_path, F.lit(1), F.greatest(size, F.lit(0)))


def relative_to(path: Column, root: Column) -> Column:
    """Rest of ``path`` below ``root`` (given without a trailing slash)."""
    return F.when(
        path.startswith(F.concat(root, F.lit("/"))),
        F.substring(path, F.length(root) + 2, F.length(path)),
    )


def copy_path(folder: Column, recording_stem: Column, ending: str) -> Column:
    """Path of a recording's hidden converted copy in ``folder``."""
    name = F.concat(F.lit("."), recording_stem, F.lit(ending))
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def copied_stem(name: Column) -> Column:
    """Stem of the recording that ``name``, known to be a copy's, belongs to."""
    return F.substring(name, F.lit(2), F.length(name) - len(RAW_COPY_ENDING) - 1)
