"""WAV files as mono samples of one rate, in column expressions.

A file is a row of the binary scan: its chunks are walked, frames become an array of channel means, and where the
rate differs a polyphase filter takes every output sample from the inputs under the filter alone.  The filter is the usual windowed sinc: 10 zero crossings
of the slower rate on each side, Kaiser window of shape 5, unit gain at zero frequency.

Defined cases: a file without frames has an empty array.  Files that aren't RIFF/WAVE, lack a chunk, or hold other than
PCM of 8 to 32 bits raise on use.  A file is one row, so it must fit in a task's memory: 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples a second of the result, zero crossings of the filter on each side, shape of its window.
RATE, CROSSINGS, SHAPE = 16000, 10, 5.0
#: Chunks that are looked through for `data`, and terms of the Bessel series.
CHUNKS, TERMS = 64, 30


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, also where f uses it inside a loop."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def little(content: Column, at: Column, width: Column) -> Column:
    """The unsigned little-endian number of `width` bytes at a position from 0."""
    one = lambda i: F.conv(F.hex(F.substring(content, at + i + 1, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(one(i), F.lit(0)) * F.pow(F.lit(256.0), i).cast("long"))


def chunks(content: Column) -> Column:
    """Positions of the bodies of `fmt ` and `data`, and the size of the latter; -1 where there is none."""
    start = F.struct(F.lit(12).cast("long").alias("at"), F.lit(-1).cast("long").alias("fmt"), F.lit(-1).cast("long").alias("data"), F.lit(0).cast("long").alias("size"))
    name = lambda s: F.substring(content, (s["at"] + 1).cast("int"), F.lit(4)).cast("string")

    def step(s: Column, _: Column) -> Column:
        size = little(content, (s["at"] + 4).cast("int"), F.lit(4))
        here = (s["data"] < 0) & (s["at"] + 8 <= F.length(content))
        moved = F.struct(
            (s["at"] + 8 + size + size % 2).alias("at"),
            F.when(name(s) == "fmt ", s["at"] + 8).otherwise(s["fmt"]).alias("fmt"),
            F.when(name(s) == "data", s["at"] + 8).otherwise(s["data"]).alias("data"),
            F.when(name(s) == "data", F.least(size, F.length(content) - s["at"] - 8)).otherwise(s["size"]).alias("size"),
        )
        return F.when(here, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(CHUNKS)), start, step)


def span(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def mono(content: Column, data: Column, size: Column, channels: Column, width: Column) -> Column:
    """Means over the channels of samples in [-1, 1)."""
    half = F.pow(F.lit(2.0), width * 8 - 1)

    def sample(i: Column) -> Column:
        raw = little(content, (data + i * width).cast("int"), width).cast("double")
        return F.when(width == 1, raw - 128).when(raw >= half, raw - 2 * half).otherwise(raw) / half

    frame = lambda i: F.aggregate(span(channels), F.lit(0.0), lambda s, c: s + sample(i * channels + c)) / channels
    return F.transform(span(F.floor(size / (channels * width))), frame)


def bessel(x: Column) -> Column:
    """The modified Bessel function of order 0 by its series."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        return let(s["term"] * (x / (2 * k)) * (x / (2 * k)), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["sum"])


def taps(up: Column, down: Column) -> Column:
    """The filter for a change of rate by up / down, of 2 * CROSSINGS * max(up, down) + 1 values."""
    most = F.greatest(up, down)
    half = most * CROSSINGS

    def tap(i: Column) -> Column:
        t = (i - half) / most
        sinc = F.when(i == half, F.lit(1.0)).otherwise(F.sin(F.lit(float(3.141592653589793)) * t) / (F.lit(float(3.141592653589793)) * t))
        ratio = (i - half) / half
        return sinc * bessel(SHAPE * F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio)))

    raw = F.transform(span(2 * half + 1), tap)
    return let(raw, lambda h: let(F.aggregate(h, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(h, lambda x: x * up / total)))


def resampled(x: Column, up: Column, down: Column) -> Column:
    """ceil(n * up / down) samples; beyond its ends the signal is 0."""
    half = F.greatest(up, down) * CROSSINGS

    def over(x: Column, h: Column) -> Column:
        def out(m: Column) -> Column:
            first = F.greatest(F.lit(0), F.ceil((m * down - half) / up)).cast("int")
            last = F.least(F.size(x) - 1, F.floor((m * down + half) / up)).cast("int")
            each = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(each, F.lit(0.0), lambda s, k: s + F.get(x, k) * F.get(h, (m * down - k * up + half).cast("int")))

        return F.transform(span(F.ceil(F.size(x) * up / down)), out)

    return let(x, lambda x: let(taps(up, down), lambda h: over(x, h)))


def divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(F.lit(1).cast("long"), s["b"])).alias("b"))), lambda s: s["a"])


def wav(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """path, file_rate, channels, n_frames, samples array<float> at `rate` of the WAV files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    c = F.col("content")
    number = lambda at, n: little(c, (F.col("k.fmt") + at).cast("int"), F.lit(n)).cast("int")
    kind = F.when(number(0, 2) == 0xFFFE, number(24, 2)).otherwise(number(0, 2))
    known = files.select("path", c, chunks(c).alias("k")).select("path", c, "k", kind.alias("kind"), number(2, 2).alias("channels"), number(4, 4).alias("file_rate"), (number(14, 2) / 8).cast("int").alias("width"))
    riff = (F.substring(c, 1, 4).cast("string") == "RIFF") & (F.substring(c, 9, 4).cast("string") == "WAVE")
    good = riff & (F.col("k.fmt") > 0) & (F.col("k.data") > 0) & (F.col("kind") == 1) & F.col("width").between(1, 4) & (F.col("channels") > 0) & (F.col("file_rate") > 0)
    x = F.when(good, mono(c, F.col("k.data"), F.col("k.size"), F.col("channels"), F.col("width"))).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" is no PCM WAV file"))).cast("array<double>"))

    def at_rate(x: Column) -> Column:
        change = let(divisor(F.lit(rate), F.col("file_rate")), lambda g: resampled(x, (F.lit(rate) / g).cast("long"), (F.col("file_rate") / g).cast("long")))
        return F.struct(F.size(x).alias("n_frames"), F.transform(F.when(F.col("file_rate") == rate, x).otherwise(change), lambda v: v.cast("float")).alias("samples"))

    return known.select("path", "file_rate", "channels", let(x, at_rate).alias("s")).select("path", "file_rate", "channels", "s.n_frames", "s.samples")
