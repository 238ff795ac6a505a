"""Display colours as Column expressions; channels are 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display colours.
GREY = (0.7, 0.7, 0.7)
BY_TYPE = {"vertical_facade": (0.95, 0.68, 0.18), "horizontal": (0.25, 0.65, 0.95), "inclined": (0.55, 0.45, 0.9)}
DIM_BY_TYPE = {"vertical_facade": (0.55, 0.38, 0.12), "horizontal": (0.12, 0.34, 0.5), "inclined": (0.28, 0.22, 0.45)}
#: Of facades of no known type, bright and dim.
UNTYPED, DIM_UNTYPED = (0.6, 0.6, 0.6), (0.18, 0.18, 0.18)
BY_SEGMENT = [(1.0, 0.2, 0.2), (1.0, 0.85, 0.1), (0.1, 0.45, 1.0), (0.2, 0.85, 0.35), (0.85, 0.25, 1.0), (1.0, 0.5, 0.1), (0.1, 0.9, 0.9), (0.95, 0.95, 0.95)]
BY_LEVEL = {0: (0.2, 0.8, 0.2), 1: (0.95, 0.8, 0.1), 2: (0.9, 0.15, 0.15), -1: (0.5, 0.5, 0.5)}
HIGHLIGHT = (0.2, 0.8, 0.2)
SOURCE, TARGET = (1.0, 0.4, 0.4), (0.4, 0.4, 1.0)
COLD, NEUTRAL, HOT = (0.03, 0.22, 1.0), (0.48, 0.48, 0.48), (1.0, 0.08, 0.02)


def channels(name: str = "") -> list[Column]:
    """Stored colours, grey where there are none."""
    return [F.coalesce(F.col(f"{name}{c}"), F.lit(g)) for c, g in zip("rgb", GREY, strict=True)]


def clipped(name: str = "") -> list[Column]:
    """Stored colours kept within 0 to 1; points without a whole colour are grey."""
    whole = F.lit(True)
    for c in "rgb":
        whole = whole & F.col(f"{name}{c}").isNotNull()
    return [F.when(whole, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"{name}{c}")))).otherwise(F.lit(g)) for c, g in zip("rgb", GREY, strict=True)]


def chosen(cases: list[tuple[Column, tuple[float, ...]]], otherwise: list[Column]) -> list[Column]:
    out = []
    for i in range(3):
        pick = F
        for test, colour in cases:
            pick = pick.when(test, F.lit(colour[i]))
        out.append(pick.otherwise(otherwise[i]) if cases else otherwise[i])
    return out


def by_type(kind: Column, otherwise: list[Column], dim: bool = False) -> list[Column]:
    """Facade colours by type, ``otherwise`` where ``kind`` is null."""
    table, rest = (DIM_BY_TYPE, DIM_UNTYPED) if dim else (BY_TYPE, UNTYPED)
    return chosen([*((kind == k, c) for k, c in table.items()), (kind.isNotNull(), rest)], otherwise)


def by_segment(segment: Column, factor: float = 0.25) -> list[Column]:
    """Segment colours in turn; points of none keep theirs, darkened."""
    turn = F.pmod(segment, F.lit(len(BY_SEGMENT)))
    return chosen([((segment >= 0) & (turn == i), c) for i, c in enumerate(BY_SEGMENT)], dimmed(channels(), factor))


def by_level(level: Column) -> list[Column]:
    return chosen([(level == k, c) for k, c in BY_LEVEL.items()], [F.lit(x) for x in BY_LEVEL[-1]])


def dimmed(colour: list[Column], factor: float) -> list[Column]:
    return [c * factor for c in colour]


def heat(value: Column, limit: Column) -> list[Column]:
    """Blue below, neutral at zero, red above, saturated beyond the limit."""
    t = F.when(limit > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value / limit))).otherwise(0.0)
    return [F.when(t < 0, F.lit(n) + (-t) * (c - n)).otherwise(F.lit(n) + t * (h - n)) for c, n, h in zip(COLD, NEUTRAL, HOT, strict=True)]
