"""Keyed Feistel permutations as Spark columns.

A point of Z_a x Z_b is a pair (l, r). Odd rounds add a keyed function of r to l
modulo a, even rounds one of l to r modulo b. Each round can be undone by
subtraction, so any number of rounds is a bijection whatever the round function.
The rounds run in one ``aggregate`` so that the expression does not grow with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Round = Callable[[Column, Column], Column]


def fast_round(key: int) -> Round:
    """For shuffles: well mixed, not secret."""
    return lambda i, x: F.xxhash64(F.lit(key), i, x)


def secret_round(key: str, tweak: Column) -> Round:
    """For pseudonyms: 56 bits of SHA-256 over key, tweak, round and half."""
    return lambda i, x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 14), 16, 10).cast("long")


def permute(left: Column, right: Column, a: Column, b: Column, f: Round, rounds: int = 8) -> Column:
    """struct<l,r>: the image of (left, right) in Z_a x Z_b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    steps = F.array(*[F.lit(i) for i in range(1, rounds + 1)])

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(acc["l"] + F.pmod(f(i, acc["r"]), a), a)).otherwise(acc["l"]).cast("long").alias("l"),
            F.when(odd, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(f(i, acc["l"]), b), b)).cast("long").alias("r"),
        )

    return F.aggregate(steps, start, step)


def permute_below(x: Column, n: int, f: Round, rounds: int = 8) -> Column:
    """Image of x under a permutation of 0..n-1, by cycle walking in Z_a x Z_b with a*b just above n.

    a is the square root of n rounded up and b = ceil(n/a), so fewer than a points
    lie outside. A walk from inside meets each of them at most once; after eight
    steps, which nearly all walks end within, the rest of that bound is walked too,
    so that the result is exact for every x.
    """
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    b = max(1, -(-n // a))
    ca, cb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def once(v: Column) -> Column:
        return F.aggregate(F.array(permute(F.floor(v / cb), v % cb, ca, cb, f, rounds)), F.lit(0).cast("long"), lambda _, p: p["l"] * cb + p["r"])

    def walk(v: Column, steps: Column) -> Column:
        return F.aggregate(steps, v, lambda y, _: F.when(y < n, y).otherwise(once(y)))

    first = walk(once(x.cast("long")), F.sequence(F.lit(1), F.lit(8)))
    # The second walk binds the first one's end, so that it is made once.
    return F.aggregate(F.array(first), F.lit(0).cast("long"), lambda _, y: F.when(y < n, y).otherwise(walk(y, F.sequence(F.lit(1), F.lit(max(1, a * b - n))))))
