"""Encodings of 3-D splats (position, colour, opacity, scale, rotation) as vectors, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTAVES, BINS = 10, 8


def bounds(rows: DataFrame) -> DataFrame:
    """One row: the least and greatest of each coordinate of position."""
    return rows.agg(*[f(F.col("position")[i]).alias(f"{n}{i}") for i in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))])


def position(rows: DataFrame) -> DataFrame:
    """rows with `position_code`: sine and cosine of each scaled coordinate at ten octaves, 60 numbers."""
    b = rows.crossJoin(F.broadcast(bounds(rows)))  # a single row
    scaled = [(F.col("position")[i] - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}") + 1e-8) for i in range(3)]
    code = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(OCTAVES - 1)), lambda d: F.array(*[f(s * F.pow(F.lit(2.0), d)) for s in scaled for f in (F.sin, F.cos)])))
    return b.withColumn("position_code", code).drop(*[f"{n}{i}" for i in range(3) for n in ("lo", "hi")])


def unit_colors(rows: DataFrame) -> DataFrame:
    """rows whose colours lie in [0, 1]: where one of all is above 1, all are taken as of [0, 255]."""
    top = rows.agg(F.coalesce(F.max(F.array_max("color")), F.lit(0.0)).alias("top_color"))
    scale = F.when(F.col("top_color") > 1, 255.0).otherwise(1.0)
    return rows.crossJoin(F.broadcast(top)).withColumn("color", F.transform("color", lambda x: x / scale)).drop("top_color")  # a single row


def color(c: Column) -> Column:
    """Weights of 8 x 8 x 8 bins, falling off with the distance from the colour's own."""
    own = [F.least(F.floor(c[i] * BINS), F.lit(BINS - 1)) for i in range(3)]

    def weight(n: Column) -> Column:
        at = [F.floor(n / (BINS * BINS)), F.floor(n / BINS) % BINS, n % BINS]
        return F.exp(-sum(((at[i] - own[i]) * (at[i] - own[i]) for i in range(1, 3)), (at[0] - own[0]) * (at[0] - own[0])) / 4.0)

    return F.transform(F.sequence(F.lit(0), F.lit(BINS**3 - 1)), weight)


def attributes(o: Column, s: Column, q: Column) -> Column:
    """64 numbers: 8 of opacity, 24 of scale, 32 of rotation, the unused ones 0."""
    e = 1e-8
    x, y, z = s[0], s[1], s[2]
    w, a, b, c = q[0], q[1], q[2], q[3]
    opacity = [o, o * o, o * o * o, F.sqrt(o + e), F.log(o + e), 1 - o, F.when(o > 0.5, 1.0).otherwise(0.0), F.when(o < 0.5, 1.0).otherwise(0.0)]
    scale = [x, y, z, x * y * z, (x + y + z) / 3, F.sqrt(x * x + y * y + z * z), x / (y + e), x / (z + e), y / (z + e), x * x, y * y, z * z, F.log(x + e), F.log(y + e), F.log(z + e)]
    turn = [w, a, b, c, w * w, a * a, b * b, c * c, w * a, w * b, w * c, a * b, a * c, b * c]
    pad = lambda n: [F.lit(0.0)] * n
    return F.array(*[v.cast("double") for v in [*opacity, *scale, *pad(24 - len(scale)), *turn, *pad(32 - len(turn))]])


def full(rows: DataFrame) -> DataFrame:
    """rows with `code`: position, colour and attributes, 60 + 512 + 64 numbers."""
    return position(unit_colors(rows)).withColumn("code", F.concat("position_code", color(F.col("color")), attributes(F.col("opacity"), F.col("scale"), F.col("rotation")))).drop("position_code")
