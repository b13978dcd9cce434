"""Small statistics and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a offset basis as two halves, and the prime 2^40 + 435.
FNV_BASIS_HIGH = 3421674724
FNV_BASIS_LOW = 2216829733
FNV_PRIME_LOW = 435
_LOW32 = 0xFFFFFFFF


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the complete pairs; NULL below two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _bytes(text: Column) -> Column:
    digits = F.hex(text.cast("binary"))
    n = F.octet_length(text)
    codes = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    return F.when(n > 0, codes).otherwise(F.array().cast("array<bigint>"))


def held_out(text: Column, folds: int = 5) -> Column:
    """Is the 64-bit FNV-1a hash of the text divisible by ``folds``?

    The hash is kept as two 32-bit halves so that no product overflows.
    """
    start = F.struct(
        F.lit(FNV_BASIS_HIGH).cast("bigint").alias("hi"), F.lit(FNV_BASIS_LOW).cast("bigint").alias("lo")
    )

    def step(acc: Column, byte: Column) -> Column:
        mixed = acc["lo"].bitwiseXOR(byte)
        product = mixed * FNV_PRIME_LOW
        high = acc["hi"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(
            high.bitwiseAND(F.lit(_LOW32)).alias("hi"), product.bitwiseAND(F.lit(_LOW32)).alias("lo")
        )

    # hash = hi * 2^32 + lo
    weight = (1 << 32) % folds
    return F.aggregate(
        _bytes(text), start, step, lambda acc: (acc["hi"] % folds * weight + acc["lo"]) % folds == 0
    )
