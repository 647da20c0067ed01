"""Display forms of durations, sizes, rates and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels of durations in nanoseconds: not available, and without end.
NOT_AVAILABLE, FOREVER = -(2**63), 2**63 - 1
NS_MS, NS_S = 1_000_000, 1_000_000_000


def _rounded(x: Column, significant: int = 3, most: int = 6) -> tuple[Column, Column]:
    """How many decimals so many significant digits take once the number is rounded (`most` at most), and the rounded number.

    Rounding may add a digit: 9.999 has two decimals before it and one after.
    """
    tiny = F.lit(1e-300)
    whole = F.floor(F.log10(F.greatest(F.abs(x), tiny))) + 1
    decimals = F.greatest(F.lit(0), F.least(F.lit(most), significant - whole))
    near = F.round(x * F.pow(F.lit(10.0), decimals)) / F.pow(F.lit(10.0), decimals)
    after = F.when(near == 0, whole).otherwise(F.floor(F.log10(F.greatest(F.abs(near), tiny)) + 1e-12) + 1)
    return F.when(after > whole, F.greatest(F.lit(0), F.least(F.lit(most), significant - after))).otherwise(decimals), near


def _digits(x: Column, significant: int = 3, most: int = 6) -> Column:
    """A number in fixed notation with so many significant digits, half up, and at most `most` decimals."""
    decimals, _ = _rounded(x, significant, most)
    out = F.format_string("%.0f", x)
    for k in range(1, most + 1):
        out = F.when(decimals == k, F.format_string(f"%.{k}f", x)).otherwise(out)
    return out


def timespan(ns: Column) -> Column:
    """N/A, Indefinite, 0 s, hours and minutes, minutes and seconds, or three digits of seconds or milliseconds.

    The unit is that of the rounded value: 59.96 s is 1 m 0 s.
    """
    seconds, size = ns / NS_S, F.abs(ns)
    shown = _rounded(size / NS_S)[1]
    whole = F.floor(size / NS_S + 0.5)
    sign = F.when(ns < 0, "-").otherwise("")
    return (
        F.when(ns.isNull() | (ns <= NOT_AVAILABLE + NS_MS), "N/A")
        .when(ns >= FOREVER - NS_MS, "Indefinite")
        .when(ns == 0, "0 s")
        .when(shown >= 3600, F.concat(sign, F.format_string("%d h %d m", F.floor(whole / 3600), F.floor(whole % 3600 / 60))))
        .when(shown >= 60, F.concat(sign, F.format_string("%d m %d s", F.floor(whole / 60), whole % 60)))
        .when((size >= NS_S) | (shown >= 1), F.concat(_digits(seconds), F.lit(" s")))
        .otherwise(F.concat(_digits(ns / NS_MS), F.lit(" ms")))
    )


def _scaled(x: Column, units: list[str], plain: Column) -> Column:
    """One decimal in the largest unit (powers of 1024) that leaves 1 or more; below 1024 the plain form."""
    out = plain
    for k, unit in enumerate(units, 1):
        out = F.when(F.abs(x) >= 1024.0**k, F.format_string(f"%.1f {unit}", x / 1024.0**k)).otherwise(out)
    return F.when(x.isNull(), "N/A").otherwise(out)


def memory(size: Column) -> Column:
    plain = F.when(size == 1, "1 byte").otherwise(F.concat(size.cast("long").cast("string"), F.lit(" bytes")))
    return _scaled(size, ["kB", "MB", "GB", "TB", "PB", "EB"], plain)


def bit_rate(bits: Column) -> Column:
    return _scaled(bits, ["kbps", "Mbps", "Gbps", "Tbps", "Pbps", "Ebps"], F.concat(bits.cast("long").cast("string"), F.lit(" bps")))


def percentage(share: Column) -> Column:
    return F.when(share.isNull(), "N/A").otherwise(F.format_string("%.2f%%", share * 100))


def frequency(x: Column) -> Column:
    whole = x == F.floor(x)
    return F.when(x.isNull(), "N/A").when(whole, F.concat(x.cast("long").cast("string"), F.lit(" Hz"))).otherwise(F.concat(x.cast("string"), F.lit(" Hz")))


def address(x: Column) -> Column:
    digits = F.hex(x.cast("long"))
    return F.when(x.isNull(), "N/A").otherwise(F.concat(F.lit("0x"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)))


def integer(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_number(x.cast("long"), 0))


def decimal(x: Column) -> Column:
    """Whole numbers grouped by thousands; else four significant digits, half even, without zeros at the end."""
    magnitude = F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-300)))).cast("int")
    out = F.bround(x, 0)
    for k in range(1, 13):
        out = F.when(3 - magnitude >= k, F.bround(x, k)).otherwise(out)
    text = F.regexp_replace(F.format_string("%.12f", out), r"\.?0+$", "")
    return F.when(x.isNull(), "N/A").when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == F.floor(x), F.format_number(x, 0)).otherwise(text)


def clock(ts: Column) -> Column:
    return F.when(ts.isNull(), "N/A").otherwise(F.date_format(ts, "HH:mm:ss"))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\r\t", "   ")


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def summary_bytes(size: Column) -> Column:
    """Sizes as summaries show them: B, KB and MB with one decimal, GB with two."""
    return (
        F.when(size.isNull(), "N/A")
        .when(size >= 1024.0**3, F.format_string("%.2f GB", size / 1024.0**3))
        .when(size >= 1024.0**2, F.format_string("%.1f MB", size / 1024.0**2))
        .when(size >= 1024, F.format_string("%.1f KB", size / 1024.0))
        .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))
    )


def _short(x: Column, unit: str) -> Column:
    """1 to 999 of a unit with three to one decimals."""
    form = lambda k: F.format_string(f"%.{k}f{unit}", x)
    return F.when(x >= 100, form(1)).when(x >= 10, form(2)).otherwise(form(3))


def summary_duration(ns: Column) -> Column:
    """Durations as summaries show them: hours, minutes and seconds from a minute on, else one unit; to a millisecond from a second on."""
    size = F.abs(ns)
    total, ms = F.floor(size / NS_S), F.floor(size % NS_S / NS_MS)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    rest = F.regexp_replace(F.format_string("%d.%03d", total % 60, ms), r"\.?0+$", "")
    last = F.when((total % 60 > 0) | (size % NS_S > 0), F.concat(rest, F.lit("s")))
    long = F.concat_ws(" ", part(F.floor(total / 3600), "h"), part(F.floor(total % 3600 / 60), "m"), last)
    seconds = F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%d.%03d", total, ms), r"0+$", ""), r"\.$", ".0"), F.lit("s"))
    shown = (
        F.when(total >= 60, long)
        .when(total >= 1, seconds)
        .when(size >= NS_MS, _short(size / NS_MS, "ms"))
        .when(size >= 1000, _short(size / 1000.0, "us"))
        .otherwise(F.concat(size.cast("string"), F.lit("ns")))
    )
    return F.when(ns.isNull(), "N/A").when(ns == 0, "0s").otherwise(F.concat(F.when(ns < 0, "-").otherwise(""), shown))


def iso(time: Column) -> Column:
    """A time as ISO text in the session's zone, with 3 decimals, or 6 if there are microseconds."""
    micros = F.unix_micros(time.cast("timestamp"))
    form = lambda pattern: F.date_format(time.cast("timestamp"), pattern)
    return F.when(micros % 1000 == 0, form("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).otherwise(form("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
