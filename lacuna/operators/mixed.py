"""Tables of mixed columns as one array of slots a row, and back.

A :class:`Layout` gives every variable its place: start, width and kind.  Binary columns pass
through, continuous ones are scaled from their bounds to 0..1, categorical ones take a slot
per level.  The same layout turns rows into slots and slots into rows, and widens or squashes
observation masks.  Everything is a narrow projection; levels and bounds are declared, or
read off a variables table once.

A null cell is null in all its slots and comes back null; so does a value that is no level.
A value beyond its bounds scales beyond 0..1 and comes back as it was.  Equal bounds scale by
1.  Reverting takes the level with the greatest slot, the first on ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("binary", "continuous", "categorical")


@dataclass(frozen=True)
class Slot:
    name: str
    kind: str
    start: int
    width: int
    levels: tuple = ()
    lower: float = 0.0
    scale: float = 1.0
    type: str = "double"


class Layout:
    """Slots of variables in their order.  ``variables``: (name, kind, levels or bounds, type)."""

    def __init__(self, variables):
        self.slots, at = [], 0
        for name, kind, spec, kept in variables:
            if kind not in KINDS:
                raise ValueError(f"{name}: unknown kind {kind!r}, known are {', '.join(KINDS)}")
            if kind == "categorical":
                if not spec or len(set(spec)) != len(spec):
                    raise ValueError(f"{name}: levels must be given, each once")
                slot = Slot(name, kind, at, len(spec), tuple(spec), type=kept)
            else:
                low, high = spec if kind == "continuous" else (0.0, 1.0)
                slot = Slot(name, kind, at, 1, lower=float(low), scale=float(high - low) or 1.0, type=kept)
            self.slots.append(slot)
            at += slot.width
        self.width = at

    @staticmethod
    def read(df: DataFrame, binary=(), continuous=(), categorical=()) -> "Layout":
        """Bounds and levels (sorted) of a table: one aggregate, whose result is one row."""
        kinds = dict(df.dtypes)
        row = df.agg(*[f(c).alias(f"{w}_{c}") for c in continuous for w, f in (("lo", F.min), ("hi", F.max))],
                     *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"lv_{c}") for c in categorical], F.count(F.lit(1))).first()
        return Layout([*[(c, "binary", None, kinds[c]) for c in binary],
                       *[(c, "continuous", (float(row[f"lo_{c}"] or 0.0), float(row[f"hi_{c}"] if row[f"hi_{c}"] is not None else 1.0)), kinds[c]) for c in continuous],
                       *[(c, "categorical", tuple(row[f"lv_{c}"]) or ("",), kinds[c]) for c in categorical]])

    def _cell(self, s: Slot) -> list[Column]:
        if s.kind != "categorical":
            value = F.col(s.name).cast("double")
            return [(value - F.lit(s.lower)) / F.lit(s.scale)] if s.kind == "continuous" else [value]
        text = F.col(s.name).cast("string")
        known = text.isin(*s.levels)
        return [F.when(known, (text == v).cast("double")) for v in s.levels]

    def process(self, df: DataFrame, out: str = "slots") -> DataFrame:
        """The table's variables as one array of doubles (other columns stay)."""
        names = {s.name for s in self.slots}
        return df.select(*[c for c in df.columns if c not in names], F.array(*[x for s in self.slots for x in self._cell(s)]).alias(out))

    def revert(self, df: DataFrame, slots: str = "slots") -> DataFrame:
        """E17 inverse: the variables from the array."""
        cols = []
        for s in self.slots:
            if s.kind == "categorical":
                own = F.slice(slots, s.start + 1, s.width)
                at = F.array_position(own, F.array_max(own))
                value = F.when(F.array_max(own).isNotNull(), F.element_at(F.array(*[F.lit(v) for v in s.levels]), at.cast("int")))
            else:
                value = F.element_at(slots, s.start + 1)
                value = value * F.lit(s.scale) + F.lit(s.lower) if s.kind == "continuous" else value
            cols.append(value.cast(s.type).alias(s.name))
        return df.select(*[c for c in df.columns if c != slots], *cols)

    def expand_mask(self, mask: str) -> Column:
        """A flag per variable (array) to a flag per slot."""
        return F.flatten(F.array(*[F.array_repeat(F.element_at(mask, i + 1), s.width) for i, s in enumerate(self.slots)]))

    def squash_mask(self, mask: str) -> Column:
        """E18 inverse: the flag of each variable's first slot."""
        return F.array(*[F.element_at(mask, s.start + 1) for s in self.slots])

    def observed(self) -> Column:
        """A flag per variable: the cell is there."""
        return F.array(*[F.col(s.name).isNotNull() for s in self.slots])
