"""Column expressions against Python's own path, integer and order rules."""

import functools
import re
from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepview.functions import labels, paths
from stepview.functions.natural import natural_key

NAMES = ["a.set", ".set", "S1.SET", "x.tar.gz", "noext", "end.", ".hidden.set", "a..b", "sub-01.set", "a b.set", "½.set"]


def one_column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_suffix_and_stem_follow_pathlib(spark):
    want = [(PurePosixPath(n).suffix, PurePosixPath(n).stem) for n in NAMES if n != "end."]
    names = [n for n in NAMES if n != "end."]
    got = list(zip(one_column(spark, names, paths.suffix), one_column(spark, names, paths.stem)))
    assert got == want


def test_is_recording(spark):
    want = [PurePosixPath(n).suffix == ".set" for n in NAMES]
    assert one_column(spark, NAMES, paths.is_recording) == want
    assert one_column(spark, ["..set"], paths.is_recording) == [False]


def test_recording_paths(spark):
    def wanted(path):
        parts = path.split("/")
        number = parts[0].split("_")[0]
        name = PurePosixPath(parts[-1])
        ok = len(parts) == 2 and re.fullmatch(r"[0-9]+\s*", number) is not None
        return ok and name.suffix == ".set" and set(name.stem) != {"."} and int(number) < 10**18

    values = [f"{d}/{n}" for d in ("1_a", "7", "8 _b", "12x_a", "_1", "9" * 19 + "_a", "0" * 30 + "4_a", "1_a/b") for n in NAMES + ["..set"]]
    assert one_column(spark, values, lambda c: c.rlike(paths.RECORDING_PATH)) == [wanted(v) for v in values]


def test_parent_and_base_name(spark):
    values = ["a/b/c", "a", "a/b"]
    assert one_column(spark, values, paths.parent) == ["a/b", "", "a"]
    assert one_column(spark, values, paths.base_name) == ["c", "a", "b"]


def test_relative_to(spark):
    df = spark.createDataFrame([("/r/a/b", "/r"), ("/rx/a", "/r")], "p string, r string")
    assert [r[0] for r in df.select(paths.relative_to(F.col("p"), F.col("r"))).collect()] == ["a/b", None]


def test_text_to_int(spark):
    def python_int(text):
        try:
            return int(text)
        except ValueError:
            return None

    values = ["7", " 7 ", "+7", "-3", "1_0", "1__0", "_1", "x1", "", "1.5", "007", "9 9"]
    assert one_column(spark, values, paths.text_to_int) == [python_int(v) for v in values]


def test_step_number_and_rejects(spark):
    names = ["1_load", "10_x_y", "7", "8 _b", "12abc_x", "½_half", "٣_a", "x_1", "99999999999999999999_b", "_1"]
    assert one_column(spark, names, paths.step_number) == [1, 10, 7, 8, None, None, None, None, None, None]
    assert one_column(spark, names, paths.step_reject_reason) == [
        None, None, None, None, "not_a_number", "not_ascii", "not_ascii", None, "number_too_large", None,
    ]


def test_copy_names(spark):
    assert one_column(spark, [".S1-raw.fif", "..a-epo.fif"], paths.copied_stem) == ["S1", ".a"]
    copies = ["1_a/.S1-raw.fif", "1_a/.-raw.fif", "1_a/S1-raw.fif", "1_a/b/.S1-raw.fif", "7/.x-epo.fif", "1_a/S1.set", "x/S1.set"]
    want = [True, False, False, False, True, True, False]
    assert one_column(spark, copies, lambda c: c.rlike(paths.RECORDING_OR_COPY_PATH)) == want
    df = spark.createDataFrame([("1_load", "S1"), ("", "S1")], "f string, s string")
    got = df.select(paths.copy_path(F.col("f"), F.col("s"), paths.EPOCHS_COPY_ENDING)).collect()
    assert [r[0] for r in got] == ["1_load/.S1-epo.fif", ".S1-epo.fif"]


def natural(text):
    return [(0, int(t), "") if t.isdigit() else (1, 0, t) for t in re.findall("[0-9]+|[^0-9]+", text)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1B/-_0é29", min_size=0, max_size=30), min_size=2, max_size=40, unique=True))
def test_natural_key_orders_like_lists(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.orderBy(natural_key(F.col("v")), "v").collect()]

    def before(a, b):
        left, right = (natural(a), a), (natural(b), b)
        return -1 if left < right else int(left > right)

    assert got == sorted(values, key=functools.cmp_to_key(before))


def test_natural_key_long_numbers(spark):
    values = ["a" + "9" * 40, "a1" + "0" * 40, "a0" + "8" * 40, "a2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.orderBy(natural_key(F.col("v"))).collect()]
    assert got == sorted(values, key=lambda v: int(v[1:]))


def test_labels(spark):
    assert one_column(spark, ["overdraw", "normalize"], labels.option_label) == ["Overdraw", "Normalize"]
    long = "x" * 300
    assert "\n" not in one_column(spark, [long], lambda c: labels.base64_text(F.encode(c, "UTF-8")))[0]
