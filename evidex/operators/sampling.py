"""Seeded draws without replacement, as arithmetic on a key and a counter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the pseudo-random numbers: a prime modulus and three multipliers.
MODULUS, OF_KEY, OF_COUNTER, OF_SEED = 2_147_483_647, 48_271, 69_621, 742_938_285
ORDER_FROM = 64  # counters from here on order what was drawn


def draw(key: Column, counter: Column, seed: int) -> Column:
    """A number in [0, MODULUS) for every key and counter.

    The fifth power is a permutation modulo this prime, so two counters of a key never draw the same
    number; every product stays below 2**62."""
    prime = F.lit(MODULUS).cast("long")
    start = F.pmod(F.pmod(key, prime) * OF_KEY + F.lit((seed + 1) * OF_SEED).cast("long"), prime)
    x = F.pmod(start + F.pmod(F.pmod(counter, prime) * OF_COUNTER, prime), prime)
    square = F.pmod(x * x, prime)
    return F.pmod(F.pmod(square * square, prime) * x, prime)


def below(key: Column, step: Column, limit: Column, seed: int) -> Column:
    """A number in [0, limit), from two draws, for limits of any size in use."""
    return F.pmod(draw(key, step * 2, seed) * MODULUS + draw(key, step * 2 + 1, seed), limit)


def distinct_ordinals(key: Column, size: Column, count: int, seed: int) -> Column:
    """array<struct<draw, ordinal>>: ``count`` different numbers below ``size`` (all, if fewer) in random
    order; null for an empty range.

    Every set is as likely as any other: step i draws below ``size - count + i + 1``, and where that
    number is already taken the largest possible one, which cannot be, takes its place."""
    kept = F.least(size, F.lit(count).cast("long"))

    def step(taken: Column, i: Column) -> Column:
        last = size - kept + i
        drawn = below(key, i, last + 1, seed)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, drawn), last).otherwise(drawn)))

    chosen = F.aggregate(F.sequence(F.lit(0).cast("long"), kept - 1), F.array().cast("array<bigint>"), step)
    ordered = F.transform(chosen, lambda n: F.struct(draw(key, n + ORDER_FROM, seed).alias("draw"), n.alias("ordinal")))
    return F.when(size > 0, F.array_sort(ordered))
