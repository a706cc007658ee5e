"""Join predicates as Column-producing expressions, so that Catalyst sees keys and conditions.

Sides are bound under the aliases ``l`` and ``r``. A key is a column name, a SQL expression that names
its side (``"l.a + 1"``), or a function of a column accessor (``lambda c: c("a") + 1``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Accessor = Callable[[str], Column]
Key = str | Callable[[Accessor], Column]
Condition = Callable[[Accessor, Accessor], Column]
Projection = Sequence[Column] | Callable[[DataFrame], DataFrame]


def _accessor(alias: str) -> Accessor:
    return lambda name: F.col(f"{alias}.`{name}`")


def _key(key: Key, alias: str) -> Column:
    if callable(key):
        return key(_accessor(alias))
    return _accessor(alias)(key) if re.fullmatch(r"\w+", key) else F.expr(key)


def _comparable(a: Column, b: Column, kinds: tuple[T.DataType, T.DataType]) -> tuple[Column, Column]:
    """The keys as they are compared: a string meets a number as a number (of nine decimals against exact ones), and matches
    nothing if it is none. All other types meet as Spark compares them."""
    text = [isinstance(k, T.StringType) for k in kinds]
    number = [isinstance(k, T.NumericType) for k in kinds]
    if not ((text[0] and number[1]) or (number[0] and text[1])):
        return a, b
    to = "double" if any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds) else "decimal(38,9)"
    return (a.try_cast(to), b) if text[0] else (a, b.try_cast(to))


def _hashable(key: Column, kinds: tuple[T.DataType, T.DataType]) -> Column:
    """A key in a type that both sides can have, so that equal keys hash alike."""
    if any(isinstance(k, T.NumericType) for k in kinds):
        return key.try_cast("double") + F.lit(0.0)  # 0.0 for -0.0, too
    return key if kinds[0] == kinds[1] else key.cast("string")


def project(frame: DataFrame, projection: Projection) -> DataFrame:
    return projection(frame) if callable(projection) else frame.select(*projection)


@dataclass(frozen=True)
class Bound:
    """A predicate tied to two frames, in the order in which the caller gave them."""

    first: DataFrame
    second: DataFrame
    condition: Column
    keys: tuple[tuple[Column, Column], ...]
    finish: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Predicate:
    """Equality on keys, or any condition, with mappings before and after the match. Immutable."""

    left_keys: tuple[Key, ...] = ()
    right_keys: tuple[Key, ...] = ()
    condition: Condition | None = None
    null_safe: bool = False
    nan_never_matches: bool = False
    left_maps: tuple[Projection, ...] = ()
    right_maps: tuple[Projection, ...] = ()
    output: tuple[Projection, ...] = ()
    swapped: bool = False
    suffixes: tuple[str, str] | None = None
    hashes: tuple[Key, Key] | None = None

    @staticmethod
    def equi(left: Key | Sequence[Key], right: Key | Sequence[Key] | None = None, *, null_safe: bool = False, nan_never_matches: bool = False) -> Predicate:
        """Key equality; `null_safe` lets null match null."""
        as_keys = lambda k: (k,) if isinstance(k, str) or callable(k) else tuple(k)
        lefts, rights = as_keys(left), as_keys(left if right is None else right)
        if not lefts or len(lefts) != len(rights):
            raise ValueError("both sides need the same number of keys, one at least")
        return Predicate(lefts, rights, null_safe=null_safe, nan_never_matches=nan_never_matches)

    @staticmethod
    def theta(condition: Condition) -> Predicate:
        """Any condition on the two rows."""
        return Predicate(condition=condition)

    @staticmethod
    def ordered(left: Key | Sequence[Key], right: Key | Sequence[Key], condition: Condition) -> Predicate:
        """An order that is coarser than the match: rows of equal sort keys are compared by `condition`."""
        return Predicate.equi(left, right).where(condition)

    def hashed_by(self, left: Key, right: Key) -> Predicate:
        """Whole numbers that deal rows to partitions, in place of the default hash; equal keys must have equal numbers."""
        return replace(self, hashes=(left, right))

    def where(self, condition: Condition) -> Predicate:
        """This predicate and one more condition."""
        old = self.condition
        return replace(self, condition=condition if old is None else lambda l, r: old(l, r) & condition(l, r))

    def swap(self) -> Predicate:
        """The same predicate for exchanged inputs; output columns keep their order."""
        return replace(self, swapped=not self.swapped)

    def map_left(self, projection: Projection) -> Predicate:
        """Project left rows before the match; the last mapping added sees the input first."""
        return replace(self, left_maps=(projection, *self.left_maps))

    def map_right(self, projection: Projection) -> Predicate:
        return replace(self, right_maps=(projection, *self.right_maps))

    def map(self, projection: Projection) -> Predicate:
        """Project the matched rows. Columns are named as in the default output."""
        return replace(self, output=(*self.output, projection))

    def with_suffixes(self, left: str, right: str) -> Predicate:
        """Append these to names that both sides have."""
        return replace(self, suffixes=(left, right))

    @property
    def has_keys(self) -> bool:
        return bool(self.left_keys)

    def key_pairs(self) -> tuple[tuple[Column, Column], ...]:
        return tuple((_key(a, "l"), _key(b, "r")) for a, b in zip(self.left_keys, self.right_keys, strict=True))

    def partitions(self, left: DataFrame, right: DataFrame, n: int) -> tuple[Column, Column]:
        """Of rows of either side, named as they are after the mappings, the partition from 0 to n - 1."""
        if self.hashes:
            numbers = tuple(_key(k, a) for k, a in zip(self.hashes, "lr", strict=True))
        else:
            kinds = self._kinds(left.alias("l"), right.alias("r"))
            numbers = tuple(F.xxhash64(*(_hashable(pair[side], k) for pair, k in zip(self.key_pairs(), kinds, strict=True))) for side in (0, 1))
        return tuple(F.coalesce(F.pmod(c, F.lit(n)), F.lit(0)).cast("int") for c in numbers)

    def _kinds(self, left: DataFrame, right: DataFrame) -> list[tuple[T.DataType, T.DataType]]:
        """The types of the keys, of sides under their aliases."""
        return [(left.select(a).schema[0].dataType, right.select(b).schema[0].dataType) for a, b in self.key_pairs()]

    def bind(self, first: DataFrame, second: DataFrame, *, hide_equality: bool = False, anti: bool = False) -> Bound:
        """`hide_equality` writes a = b as a <= b and a >= b, for plans that must stay nested loops."""
        left, right = (second, first) if self.swapped else (first, second)
        left, right = reduce(project, self.left_maps, left), reduce(project, self.right_maps, right)
        if anti and self.output:
            raise ValueError("an anti join returns bare left rows; it takes no output mapping")
        clash = set(left.columns) & set(right.columns)
        if clash and not anti and not self.suffixes:
            raise ValueError(f"both sides have {sorted(clash)}; rename them or give suffixes")

        def finish(joined: DataFrame) -> DataFrame:
            ends = self.suffixes or ("", "")
            out = joined.select(*(F.col(f"{a}.`{n}`").alias(n + (end if n in clash else "")) for a, side, end in (("l", left, ends[0]), ("r", right, ends[1])) for n in side.columns))
            return reduce(project, self.output, out)

        left, right = left.alias("l"), right.alias("r")
        kinds = self._kinds(left, right)
        pairs = tuple(_comparable(a, b, k) for (a, b), k in zip(self.key_pairs(), kinds, strict=True))
        terms: list[Column] = []
        for (a, b), kind in zip(pairs, kinds, strict=True):
            if hide_equality:
                ordered = (a <= b) & (a >= b)
                terms.append((ordered | (a.isNull() & b.isNull())) if self.null_safe else ordered)
            else:
                terms.append(a.eqNullSafe(b) if self.null_safe else a == b)
            if self.nan_never_matches:
                terms += [~F.coalesce(F.isnan(c), F.lit(False)) for c, k in zip((a, b), kind, strict=True) if isinstance(k, (T.FloatType, T.DoubleType))]
        if self.condition is not None:
            terms.append(self.condition(_accessor("l"), _accessor("r")))
        if not terms:
            terms.append(F.lit(True))
        first, second = (right, left) if self.swapped else (left, right)
        return Bound(first, second, reduce(lambda x, y: x & y, terms), pairs, finish)
