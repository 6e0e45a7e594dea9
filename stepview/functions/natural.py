"""Natural order as an ordinary sortable string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """A string whose plain order is the natural order of ``text``.

    Every run of digits becomes NUL, its count of significant digits on five
    places, then those digits. Runs thus compare by value whatever their
    length, ahead of any other character. One string is cheaper to
    shuffle, sort and range-partition on than an array of structs. Names that
    differ in leading zeros only share a key: order by the text as well.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        number = F.concat(F.lit("\0"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits)
        return F.when((run >= "0") & (run < ":"), number).otherwise(run)

    return F.array_join(F.transform(runs, encode), "")
