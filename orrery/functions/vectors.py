"""Vector, sphere and hashing functions as column expressions; all arithmetic is in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2sq(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def normalize(a: Column, guard: float = 1e-8) -> Column:
    n = norm(a) + guard
    return F.transform(doubles(a), lambda x: x / n)


def normalize_floor(a: Column, floor: float = 1e-10) -> Column:
    """Divides by the norm, or by floor where the norm is less."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(doubles(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def geodesic(a: Column, b: Column, clip: float = 1.0) -> Column:
    return F.acos(F.greatest(F.lit(-clip), F.least(F.lit(clip), dot(a, b))))


def exp_map(base: Column, tangent: Column) -> Column:
    return F.zip_with(doubles(base), doubles(tangent), lambda x, y: x + y)


def log_map(base: Column, point: Column) -> Column:
    return F.zip_with(doubles(point), doubles(base), lambda x, y: x - y)


def tangent(v: Column, base: Column) -> Column:
    """v without its part along base."""
    d = dot(v, base)
    return F.zip_with(doubles(v), doubles(base), lambda x, y: x - d * y)


def exp_map_sphere(base: Column, t: Column) -> Column:
    """The point of the unit sphere that lies from base in the direction t, as far as t is long."""
    n = norm(t)
    return F.when(n < 1e-12, doubles(base)).otherwise(F.zip_with(doubles(base), doubles(t), lambda x, y: F.cos(n) * x + F.sin(n) * y / n))


def log_map_sphere(base: Column, point: Column) -> Column:
    u, theta = tangent(point, base), geodesic(base, point)
    n = norm(u)
    return F.when(n < 1e-12, F.transform(u, lambda x: x * 0)).otherwise(F.transform(u, lambda x: x * theta / n))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def md5_mod(text: Column, n: int) -> Column:
    """The MD5 digest as a big-endian number, modulo n (below 2**31)."""
    h = F.md5(text.cast("binary"))
    parts = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return reduce(lambda acc, p: F.pmod(acc * F.lit(4294967296 % n) + p, F.lit(n)), parts, F.lit(0).cast("long"))


def query_key(vector: Column, k: Column, filters: Column) -> Column:
    """What a cached result is kept under: of the vector's values, k and the filter."""
    body = F.array_join(F.transform(doubles(vector), lambda x: F.format_number(x, 6)), ",")
    return F.concat(F.substring(F.sha2(body, 256), 1, 16), F.lit("_"), F.substring(F.sha2(F.concat(F.lit("k="), k.cast("string"), F.lit("|filters="), filters), 256), 1, 8))


def quat_normalize(q: Column) -> Column:
    n = norm(q)
    return F.when(n > 0, F.transform(doubles(q), lambda x: x / n)).otherwise(F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]))


def quat_matrix(q: Column) -> Column:
    """Rows of the rotation of a quaternion (w, x, y, z), in the convention in which [0][1] is 2 (xy + wz)."""
    w, *u = (quat_normalize(q)[i] for i in range(4))
    length = u[0] * u[0] + u[1] * u[1] + u[2] * u[2]

    def cell(i: int, j: int) -> Column:
        if i == j:
            return w * w - length + 2 * u[i] * u[i]
        turn = w * u[3 - i - j]
        return 2 * (u[i] * u[j] + (turn if (j - i) % 3 == 1 else -turn))

    return F.array(*[F.array(*[cell(i, j) for j in range(3)]) for i in range(3)])


def covariance(scale: Column, q: Column) -> Column:
    """(R S)(R S)^T of a splat."""
    m = quat_matrix(q)
    s = doubles(scale)
    return F.array(*[F.array(*[sum((m[i][k] * s[k] * m[j][k] * s[k] for k in range(1, 3)), m[i][0] * s[0] * m[j][0] * s[0]) for j in range(3)]) for i in range(3)])


def kappa_of(mean: Column, var: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(100.0), 1 / (var + 1e-8 + mean + 1e-8)))


def batch_estimate(memory_mb: Column) -> Column:
    """How many rows at a time fit half of a memory, at 3 kB each: between 10 and 1000."""
    return F.greatest(F.lit(10), F.least(F.lit(1000), (memory_mb * 0.5 * 1024 / 3).cast("long")))


def within(point: Column, low: Column, high: Column) -> Column:
    """Inside an axis-aligned box, its faces included."""
    return F.forall(F.zip_with(point, low, lambda a, b: a >= b), lambda x: x) & F.forall(F.zip_with(point, high, lambda a, b: a <= b), lambda x: x)


SQL_FUNCTIONS = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
}


def register(spark: SparkSession) -> None:
    """The vector functions for SQL text; Catalyst inlines them."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
