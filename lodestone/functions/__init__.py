"""Vector functions as Column expressions, and the same under SQL names.

All arithmetic is in DOUBLE and sums run from left to right, so results are the
same bits on every plan. Where the dimension is known, distances unroll into
plain arithmetic, which whole-stage code generation compiles; otherwise they are
higher-order functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UNROLL = 128  # largest dimension that is unrolled


def _fold(a: Column, b: Column, term, dim: int | None) -> Column:
    if dim and dim <= UNROLL:
        return reduce(lambda s, i: s + term(F.get(a, F.lit(i)), F.get(b, F.lit(i))), range(1, dim), term(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y), dim)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product."""
    return _fold(a, b, lambda x, y: x * y, dim)


def norm(a: Column, dim: int | None = None) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a, dim))


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """Cosine similarity; null where a length is zero."""
    return dot(a, b, dim) / F.nullif(norm(a, dim) * norm(b, dim), F.lit(0.0))


def normalize(a: Column, dim: int | None = None) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = norm(a, dim)
    length = F.when(n == 0.0, F.lit(1.0)).otherwise(n)
    return over(a, length)


def over(a: Column, length: Column) -> Column:
    """Every element of a over length, which is evaluated once."""
    return F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, n: x / n)


def pad(a: Column, size: int) -> Column:
    """a cut or filled with zeros to size elements."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def mips_query(a: Column, dim: int | None = None) -> Column:
    """A query vector of the reduction of inner product to distance: unit length, then a zero."""
    return F.concat(normalize(a, dim), F.array(F.lit(0.0)))


def mips_base(a: Column, largest: Column, dim: int | None = None) -> Column:
    """A base vector of that reduction: over the largest length, then what is missing to unit length."""
    scaled = over(a, largest)
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, a, dim) / (largest * largest)))
    return F.concat(scaled, F.array(rest))


#: SQL functions of the same meaning.
SQL = {
    "l2sq": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    "dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vnorm": "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vnormalize": "(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(a, x -> x / if(vnorm(a) = 0D, 1D, vnorm(a)))",
}


def register(spark: SparkSession) -> None:
    """Create the SQL functions for this session."""
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


# Start and factor of the two FNV-1a hashes of the visited filter, and its entries.
BLOOM = ((0xCBF29CE4, 0x01000193), (0x84222325, 0x1B3))
BLOOM_ENTRIES = 399887


def bloom_place(x: Column, start: int, factor: int) -> Column:
    """Place of a 32-bit number in the visited filter: FNV-1a over its bytes, low first, in 64 unsigned bits.

    The hash is kept in two halves of 32 bits, so that no product overflows a BIGINT.
    """
    low = (1 << 32) - 1
    hi, lo = F.lit(start >> 32).cast("bigint"), F.lit(start & low).cast("bigint")
    for shift in (0, 8, 16, 24):
        product = lo.bitwiseXOR(F.shiftright(x.cast("bigint"), shift).bitwiseAND(F.lit(255))) * factor
        hi, lo = (hi * factor + F.shiftright(product, 32)).bitwiseAND(F.lit(low)), product.bitwiseAND(F.lit(low))
    return ((hi % BLOOM_ENTRIES) * ((1 << 32) % BLOOM_ENTRIES) + lo) % BLOOM_ENTRIES
