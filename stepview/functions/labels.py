"""Texts shown for menu entries and encoded file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def option_label(option: Column) -> Column:
    return F.initcap(option)


def participant_label(participant: Column, n_files: Column) -> Column:
    return F.format_string("%s [%d]", participant, n_files)


def base64_text(content: Column) -> Column:
    """Base64 on one line, whatever ``spark.sql.chunkBase64String.enabled`` says."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")
