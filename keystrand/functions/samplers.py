"""Samplers for synthetic workloads: expressions of a row number and a seed, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(row: Column, seed: int, salt: int) -> Column:
    """A number in [0, 1) from a row number: the first 52 bits of the md5 of "seed/salt/row", which
    any SQL engine can make too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit(salt), row)), 1, 13), 16, 10).cast("long") / float(1 << 52)


def uniform_key(u: Column, n: Column) -> Column:
    """A key number from 0 to n - 1."""
    return F.least(F.floor(u * n), n - 1).cast("long")


def zeta(n: int, theta: float) -> float:
    """The sum of i^-theta up to n, its tail by the Euler-Maclaurin formula."""
    head = min(n, 1000)
    out = math.fsum(i**-theta for i in range(1, head + 1))
    if n > head:
        a, b = head + 0.0, n + 0.0
        area = math.log(b / a) if theta == 1 else (b ** (1 - theta) - a ** (1 - theta)) / (1 - theta)
        out += area + (b**-theta - a**-theta) / 2 + theta * (a ** (-theta - 1) - b ** (-theta - 1)) / 12
    return out


def zipf_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    """A rank from 1 to n with probability about rank^-theta, by inverting the distribution.

    Exact for ranks 1 and 2 and continuous beyond (Gray et al., 1994); theta below 1 as it is,
    theta of 1 or more taken as 0.999999."""
    theta = min(theta, 0.999999)
    total = zeta(n, theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / total) if n > 2 else 1.0
    rank = 1 + F.floor(n * F.pow(eta * u - eta + 1, 1 / (1 - theta)))
    return F.least(F.greatest(F.when(u * total < 1, 1).when(u * total < 1 + 0.5**theta, 2).otherwise(rank), F.lit(1)), F.lit(n)).cast("long")


def latest_key(rank: Column, n: Column) -> Column:
    """The key number that many places before the newest of n keys."""
    return n - F.least(F.greatest(rank, F.lit(1)), n)


def pick(u: Column, mix: dict[str, float]) -> Column:
    """The operation whose share of the cumulated mix holds u; the last one beyond rounding."""
    names = [k for k, v in mix.items() if v > 0]
    out, below = None, 0.0
    for name in names:
        below += mix[name]
        out = F.when(u < below, name) if out is None else out.when(u < below, name)
    return out.otherwise(names[-1])


def scan_length(u: Column, most: int) -> Column:
    """1 to ``most``, uniformly."""
    return (1 + F.least(F.floor(u * most), F.lit(most - 1))).cast("int")


def value_bytes(row: Column, size: int, seed: int) -> Column:
    """``size`` pseudo-random bytes from a row number."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(0, (size - 1) // 32))), lambda i: F.sha2(F.concat_ws("/", F.lit(seed), row, i), 256))
    return F.unhex(F.substring(F.array_join(blocks, ""), 1, 2 * size))
