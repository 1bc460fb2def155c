import os

import pytest

from sluiceway.functions.averages import EMA, TimeWeightedEMA
from sluiceway.functions.compose import Compose, RunAll, chdir
from sluiceway.functions.sizes import parse_size, size_column


@pytest.mark.parametrize(("text", "size"), [("5GB", 5368709120), ("200MB", 209715200), ("1.5KB", 1536), ("2TB", 2199023255552), ("300B", 300), (" 5 GB ", 5368709120), (" 1.5 KB", 1536), ("0KB", 0), ("0B", 0)])
def test_sizes(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", ["5XYZ", "NotASize", "abcMB", "5.5.5GB", "", "   ", "-1KB"])
def test_no_sizes(text):
    with pytest.raises(ValueError):
        parse_size(text)


def test_size_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("1.5 kb",), ("x",), (None,), ("5.5.5GB",)], "s string").select(size_column(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [1536, None, None, None]


def test_ema():
    e = EMA(0.3)
    for x in (100, 150, 200, 250):
        e(x)
    assert e.value == pytest.approx(228.12212133175416)
    assert e.peek(300) == pytest.approx(254.0418064019809)
    assert e.value == pytest.approx(228.12212133175416)
    assert EMA().value == 0


def test_time_weighted_ema():
    e = TimeWeightedEMA(0.001)
    for t, x in ((1695419000, 100), (1695419100, 150), (1695419800, 200), (1695420400, 250)):
        e(x, t)
    assert e.value == pytest.approx(215.00310219329043)
    assert e.timestamp == 1695420400


def test_folds_agree_with_objects(spark):
    from pyspark.sql import functions as F

    from sluiceway.functions.averages import ema, time_weighted_ema

    rows = [(k % 3, float(100 * k * k % 777), (k * 37) % 91) for k in range(60)] + [(3, 5.0, 1), (3, None, 2), (4, 1.0, 7), (4, 2.0, 7)]
    df = spark.createDataFrame(rows, "k int, x double, t long")
    plain, timed = {}, {}
    for k, x, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[2], r[1])):
        plain.setdefault(k, EMA())(x)
        timed.setdefault(k, TimeWeightedEMA(0.05))(x, t)
    got = {r.k: r.ema for r in ema(df, ["k"], ["t", "x"], "x").collect()}
    assert got == pytest.approx({k: e.value for k, e in plain.items()})
    got = {r.k: r.ema for r in time_weighted_ema(df, ["k"], ["t", "x"], F.col("t").cast("double"), "x", 0.05).collect()}
    assert got == pytest.approx({k: e.value for k, e in timed.items()})


def test_compose_and_run_all():
    assert Compose(lambda x: x + 1, lambda x: x * 10, lambda x: x - 3)(5) == 21
    with pytest.raises(ValueError):
        Compose()
    seen = []
    assert RunAll(lambda x: seen.append(("a", x)), lambda x: seen.append(("b", x)))(7) is None
    assert seen == [("a", 7), ("b", 7)]


def test_chdir(tmp_path):
    before = os.getcwd()
    with pytest.raises(KeyError), chdir(str(tmp_path)):
        assert os.path.samefile(os.getcwd(), tmp_path)
        raise KeyError
    assert os.getcwd() == before
