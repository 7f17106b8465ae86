"""Random numbers from counters in plain integer arithmetic: any engine computes the same draws.

A draw depends on its seed and counters alone, so a repeated task, another partitioning or another
engine gives the same sample.  All products stay below 2^63.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
MULTIPLIER = 0x45D9F3B


def mixed(x: Column) -> Column:
    """A bijection of 32-bit numbers that spreads every bit."""
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MULTIPLIER).cast("long")
        x = x.bitwiseAND(F.lit(MASK).cast("long"))
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform(seed: int, *counters: Column) -> Column:
    """A number from 0 to 2^32 - 1 for every combination of counters, which are below 2^32."""
    start = mixed(F.lit(seed & MASK).cast("long"))
    return reduce(lambda h, c: mixed(h.bitwiseXOR(c.cast("long"))), counters, start)


def below(seed: int, bound: Column, *counters: Column) -> Column:
    """A number from 0 to ``bound`` - 1."""
    return (uniform(seed, *counters) % bound).cast("int")


def order_key(seed: int, *keys: Column) -> Column:
    """A text by which rows stand in a random but fixed order."""
    shown = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *shown).cast("binary"))


# --- the same for another engine ----------------------------------------------------------

def mixed_sql(x: str, names: str = "m") -> str:
    """``mixed`` as a SQL expression over a BIGINT."""
    for _ in range(2):
        x = f"(list_transform([{x}], lambda {names}: (xor({names}, {names} >> 16) * {MULTIPLIER}) & {MASK})[1])"
    return f"(list_transform([{x}], lambda {names}: xor({names}, {names} >> 16))[1])"


def uniform_sql(seed: int, *counters: str) -> str:
    out = mixed_sql(f"{seed & MASK}::BIGINT")
    for c in counters:
        out = mixed_sql(f"xor({out}, ({c})::BIGINT)")
    return out
