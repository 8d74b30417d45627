"""A keyed permutation of dense positions, as a column expression.

A generalised Feistel network over the pairs (position div b, position mod b) with a * b at least the number of
positions: a bijection of 0..a*b-1 for any round function. Images beyond the last position are
permuted again until they fall inside; since fewer than a pairs are outside, the longest such walk is found
beforehand from those alone. A new order for every epoch costs arithmetic and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.functions.vectors import bind

# --- fixed values: a 32-bit mixing function --------------------------------------------
MIX, MIX_SHIFT, MASK_32 = 0x45D9F3B, 16, 0xFFFFFFFF
# ---------------------------------------------------------------------------------------
ROUNDS = 6


def mixed(x):
    """32 mixed bits of an int64 array or a Python number."""
    x = x & MASK_32
    for _ in range(2):
        x = (x * MIX) & MASK_32
        x = x ^ (x >> MIX_SHIFT)
    return x


def _mixed_column(x: Column) -> Column:
    for _ in range(2):
        x = bind((x.bitwiseAND(F.lit(MASK_32)) * F.lit(MIX)).bitwiseAND(F.lit(MASK_32)),
                 lambda v: v.bitwiseXOR(F.shiftright(v, MIX_SHIFT)))
    return x


@dataclass(frozen=True)
class Permutation:
    """The order of one epoch: ``size`` positions, a, b, the keys of the rounds, and the longest walk."""

    size: int
    a: int
    b: int
    keys: tuple[int, ...]
    walk: int

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i, key in enumerate(self.keys):
            if i % 2:
                right = (right + mixed(left ^ key)) % self.b
            else:
                left = (left + mixed(right ^ key)) % self.a
        return left * self.b + right

    def of(self, positions: np.ndarray) -> np.ndarray:
        """Where each position goes, in numpy."""
        x = self._once(np.asarray(positions, dtype="int64"))
        while (outside := x >= self.size).any():
            x[outside] = self._once(x[outside])
        return x

    def column(self, position: Column) -> Column:
        """Where each position goes, as an expression; NULL stays NULL."""
        steps = F.array(*[F.struct(F.lit(key).cast("long").alias("key"), F.lit(bool(i % 2)).alias("odd"))
                          for i, key in enumerate(self.keys)])

        def round_(state: Column, step: Column) -> Column:
            left, right = state["l"], state["r"]
            mix = _mixed_column(F.when(step["odd"], left).otherwise(right).bitwiseXOR(step["key"]))
            return F.struct(
                F.when(step["odd"], left).otherwise((left + mix) % self.a).alias("l"),
                F.when(step["odd"], (right + mix) % self.b).otherwise(right).alias("r"))

        def once(x: Column) -> Column:
            start = F.struct(F.floor(x / F.lit(self.b)).cast("long").alias("l"), (x % self.b).cast("long").alias("r"))
            return F.aggregate(steps, start, round_, lambda s: s["l"] * self.b + s["r"])

        walks = F.array(*[F.lit(i) for i in range(self.walk)])
        first = once(position.cast("long"))
        if not self.walk:
            return first
        return F.aggregate(walks, first, lambda x, _: F.when(x >= self.size, once(x)).otherwise(x))

    def sql(self, position: str) -> str:
        return permutation_sql(position, str(self.size), str(self.a), str(self.b), self.keys, self.walk)


def permutation_sql(position: str, size: str, a: str, b: str, keys: tuple[int, ...], walk: int) -> str:
    """Where a position goes, in DuckDB's dialect; ``size``, ``a`` and ``b`` may be columns, and ``walk`` any number that is
    large enough. State and keys are entries of one list."""
    def mix(v: str) -> str:
        for _ in range(2):
            v = f"xor(({v}) * {MIX} & {MASK_32}, (({v}) * {MIX} & {MASK_32}) >> {MIX_SHIFT})"
        return v

    left = f"((s // {b} + {mix(f'xor(s % {b}, k // 2)')}) % {a}) * {b} + s % {b}"
    right = f"(s // {b}) * {b} + (s % {b} + {mix(f'xor(s // {b}, k // 2)')}) % {b}"
    steps = ", ".join(str(key * 2 + i % 2) for i, key in enumerate(keys))

    def once(x: str) -> str:
        return (f"list_reduce([CAST({x} AS BIGINT), {steps}]::BIGINT[], "
                f"lambda s, k: CASE WHEN k % 2 = 1 THEN {right} ELSE {left} END)")

    if not walk:
        return once(position)
    turns = ", ".join("0" for _ in range(walk))
    return f"list_reduce([{once(position)}, {turns}]::BIGINT[], lambda x, turn: CASE WHEN x >= {size} THEN {once('x')} ELSE x END)"


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> tuple[int, ...]:
    keys, state = [], mixed(mixed(seed) + epoch)
    for i in range(rounds):
        state = mixed(state + i + 1)
        keys.append(int(state))
    return tuple(keys)


def permutation(size: int, seed: int, epoch: int, rounds: int = ROUNDS) -> Permutation:
    """The order of an epoch over ``size`` positions."""
    b = max(1, math.isqrt(max(size - 1, 0)) + 1)
    a = max(1, -(-size // b))
    keys = round_keys(seed, epoch, rounds)
    plain = Permutation(size, a, b, keys, 0)
    x, walk, turn = np.arange(size, a * b, dtype="int64"), 0, 0
    while len(x):
        turn += 1
        image = plain._once(x)
        inside = image < size
        if inside.any():
            walk = turn
        rest = image[~inside]
        if len(rest) == len(x) and np.array_equal(np.sort(rest), np.sort(x)):
            break  # cycles that no position inside ever enters
        x = rest
    return Permutation(size, a, b, keys, walk)
