"""Hashes over the UTF-8 bytes of a string, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the FNV-1a hash.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211


def _bytes(text: Column) -> Column:
    """Byte values of a string."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexed), F.lit(2))
    return F.when(F.length(hexed) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("bigint")))


def fnv1a32(text: Column) -> Column:
    """FNV-1a 32 as a long."""
    return F.aggregate(_bytes(text), F.lit(FNV32_OFFSET).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(FNV32_PRIME), F.lit(1 << 32)))


def fnv1a64(text: Column) -> Column:
    """FNV-1a 64 as decimal(20,0).

    The state is kept as two 32-bit halves in longs: the prime is 2**40 + 435, so neither product
    overflows and no decimal arithmetic is needed within the loop.
    """
    lo0, hi0 = FNV64_OFFSET & 0xFFFFFFFF, FNV64_OFFSET >> 32
    low_prime = FNV64_PRIME & 0xFFFFFFFF
    m = F.lit((1 << 32) - 1)

    def step(h, b):
        x = h["lo"].bitwiseXOR(b)
        product = x * low_prime
        lo = product.bitwiseAND(m)
        hi = (F.shiftright(product, 32) + h["hi"] * low_prime + F.shiftleft(x, 8)).bitwiseAND(m)
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    zero = F.struct(F.lit(hi0).cast("bigint").alias("hi"), F.lit(lo0).cast("bigint").alias("lo"))
    done = lambda h: (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.aggregate(_bytes(text), zero, step, done)


def sha256_head(text: Column) -> Column:
    """The first 8 bytes of SHA-256, big-endian, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def sampled(text: Column, rate: float | Column) -> Column:
    """True for the same share of keys at every run: the hash mod 10,000 lies below rate * 10,000."""
    below = F.floor((F.lit(rate) if not isinstance(rate, Column) else rate) * 10000)
    return F.pmod(fnv1a32(text), F.lit(10000)) < below
