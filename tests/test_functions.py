import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from eventloom.functions import formatting, naming, parsing
from eventloom.functions.percentiles import nearest_rank, percentile_exc


def shown(spark, build, values, kind):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"i int, x {kind}").select("i", build(F.col("x")).alias("t")).collect()
    return [r["t"] for r in sorted(rows)]


def test_display_forms(spark):
    ms = 1_000_000
    assert shown(spark, formatting.timespan, [None, -(2**63), 2**63 - 1, 0, 999_500_000, 999 * ms, 1000 * ms, 1_500, 61_000 * ms, 3_723_000 * ms, 12_345_678], "long") == ["N/A", "N/A", "Indefinite", "0 s", "1.00 s", "999 ms", "1.00 s", "0.00150 ms", "1 m 1 s", "1 h 2 m", "12.3 ms"]
    assert shown(spark, formatting.timespan, [9_999_000, 59_960 * ms, 3_599_900 * ms, 75_600 * ms, 999_960, 83, -9_999_000, 99_960 * 1000], "long") == ["10.0 ms", "1 m 0 s", "1 h 0 m", "1 m 16 s", "1.00 ms", "0.000083 ms", "-10.0 ms", "100 ms"]
    assert shown(spark, formatting.summary_duration, [None, 0, 5, 1500, 12_345, 123_456, 1_500_000, 45 * ms, 123_456_000, 1500 * ms, 2000 * ms, 60_000 * ms, 3_605_250 * ms, -5, 610_000 * ms + 5], "long") == [
        "N/A", "0s", "5ns", "1.500us", "12.35us", "123.5us", "1.500ms", "45.00ms", "123.5ms", "1.5s", "2.0s", "1m", "1h 5.25s", "-5ns", "10m 10s",
    ]
    assert shown(spark, formatting.iso, [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120_000), datetime(2024, 1, 2, 3, 4, 5, 7)], "timestamp_ntz") == ["2024-01-02T03:04:05.000Z", "2024-01-02T03:04:05.120Z", "2024-01-02T03:04:05.000007Z"]
    assert shown(spark, formatting.memory, [0, 1, 512, 1024, 1_048_576, None], "long") == ["0 bytes", "1 byte", "512 bytes", "1.0 kB", "1.0 MB", "N/A"]
    assert shown(spark, formatting.bit_rate, [-1024, 2560, 3], "long") == ["-1.0 kbps", "2.5 kbps", "3 bps"]
    assert shown(spark, formatting.integer, [1000, -4200, None], "long") == ["1,000", "-4,200", "N/A"]
    assert shown(spark, formatting.decimal, [1.5625, 12345.0, float("nan"), float("inf"), 0.00012345678, 123.456], "double") == ["1.562", "12,345", "NaN", "Infinity", "0.0001235", "123.5"]
    assert shown(spark, formatting.percentage, [0.1234, None], "double") == ["12.34%", "N/A"]
    assert shown(spark, formatting.frequency, [3.0, 2.5], "double") == ["3 Hz", "2.5 Hz"]
    assert shown(spark, formatting.address, [255, 2**40], "long") == ["0x000000FF", "0x10000000000"]
    assert shown(spark, formatting.summary_bytes, [5, 2048, 3 * 1024**2, 5 * 1024**3], "long") == ["5 B", "2.0 KB", "3.0 MB", "5.00 GB"]
    assert shown(spark, formatting.one_line, ["a\nb\tc"], "string") == ["a b c"]


def test_names(spark):
    assert shown(spark, naming.class_name, ["[I", "[[Ljava/lang/String;", "java/lang/Object", "I"], "string") == ["int[]", "java.lang.String[][]", "java.lang.Object", "I"]
    assert shown(spark, naming.parameters, ["(IJLjava/lang/String;[[B)V", "()V"], "string") == ["int, long, String, byte[][]", ""]
    assert shown(spark, naming.is_system_class, ["java/lang/ClassLoader", "javaxyz.Foo", "com.sundry.Bar", "com.sun.A"], "string") == [True, False, False, True]
    assert shown(spark, naming.short_class, ["a.b.C", "a.C", "not a.class.name x"], "string") == ["C", "a.C", "not a.class.name x"]
    assert shown(spark, naming.short_method, ["a.B.c(int, long)", "a.B.d()"], "string") == ["a.B.c(...)", "a.B.d()"]


def test_arguments():
    assert parsing.duration_ns("1h30m5s10ms3us2ns") == 5_405_010_003_002 and parsing.duration_ns("-1.5s") == -1_500_000_000
    assert parsing.duration_ns("9999d") == parsing.MOST_NS
    assert parsing.size_bytes("100k") == 102_400 and parsing.size_bytes("1.5gb") == 3 * 2**29 and parsing.size_bytes("7") == 7
    assert parsing.instant("2024-01-02T03:04:05+02:00") == datetime(2024, 1, 2, 1, 4, 5, tzinfo=timezone.utc)
    for bad in ("", "5", "h", "1x"):
        with pytest.raises(ValueError):
            parsing.duration_ns(bad)
    with pytest.raises(ValueError):
        parsing.instant("12:30")
    with pytest.raises(ValueError):
        parsing.size_bytes("k")


def plain_exc(values, p):
    values = sorted(values)
    place = min(max(p / 100 * (len(values) + 1) - 1, 0), len(values) - 1)
    low = int(place)
    return values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_percentiles(spark):
    rng = random.Random(4)
    rows = [(k % 7 if k % 7 else None, rng.choice([None, rng.randint(0, 9), rng.random() * 100])) for k in range(400)] + [(99, None), (98, 5.0)]
    rows = [(a, None if b is None else float(b)) for a, b in rows]
    df = spark.createDataFrame(rows, "g int, x double")
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    got = {r["g"]: r for r in percentile_exc(df, ["g"], "x", {"a": 50, "b": 99.9, "c": 1}).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert [got[g][c] for c in "abc"] == pytest.approx([plain_exc(values, p) for p in (50, 99.9, 1)])
    near = {r["g"]: r["m"] for r in nearest_rank(df, ["g"], "x", {"m": 95}).collect()}
    assert near == {g: sorted(v)[min(len(v) - 1, len(v) * 95 // 100)] for g, v in groups.items()}
    assert percentile_exc(df.where("false"), [], "x", {"a": 50}).first()["a"] is None
