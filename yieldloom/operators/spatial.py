"""Wafer-map neighbourhood risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from yieldloom.functions.grades import wafer_status
from yieldloom.plans import measured

NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


#: Positions of a tile's side: a tile is one 64-bit map of its positions.
SIDE = 8
_SEEN, _BAD = "_seen", "_bad"


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, F.lit(by) if isinstance(by, int) else by)


def _bits(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _tile(c: str) -> Column:
    return _shift("shiftright", F.col(c).cast("long"), 3)


def _bit(x: Column, y: Column) -> Column:
    """The place of a position in its tile's map; a missing coordinate has place 0 of its side."""
    inside = lambda c: F.coalesce(c.cast("long").bitwiseAND(F.lit(SIDE - 1)), F.lit(0))
    return (inside(x) * SIDE + inside(y)).cast("int")


def _tile_maps(state: DataFrame, wafer: Sequence[str], x: str, y: str) -> DataFrame:
    """Per tile, for each of the eight directions, which positions have a neighbour there, and which a bad one.

    Tiles, not dies, are sent to the tiles around them. Positions without x (or y) are one line of their own: each is
    its own neighbour across it.
    """
    one = _shift("shiftleft", F.lit(1).cast("long"), _bit(F.col(x), F.col(y)))
    tiles = state.groupBy(*wafer, _tile(x).alias("_tx"), _tile(y).alias("_ty")).agg(
        F.bit_or(one).alias(_SEEN), F.bit_or(F.when(~F.col("_pass"), one).otherwise(F.lit(0).cast("long"))).alias(_BAD)
    )
    hops = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    sent = tiles.withColumn("_hop", F.explode(F.array(*hops))).select(
        *wafer, (F.col("_tx") - F.col("_hop.dx")).alias("_tx"), (F.col("_ty") - F.col("_hop.dy")).alias("_ty"), "_hop", _SEEN, _BAD
    )
    at = lambda name, dx, dy: f"{name}{dx + 1}{dy + 1}"
    none = F.lit(0).cast("long")
    here = lambda dx, dy: (F.col("_hop.dx") == dx) & (F.col("_hop.dy") == dy)
    met = sent.groupBy(*wafer, "_tx", "_ty").agg(
        *[F.bit_or(F.when(here(dx, dy), F.col(name)).otherwise(none)).alias(at(name, dx, dy)) for name in (_SEEN, _BAD) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    ).filter(F.col(at(_SEEN, 0, 0)) != 0)

    def across(name: str, dx: int, dy: int) -> Column:
        own, side = F.col(at(name, 0, dy)), F.col(at(name, dx, dy))
        if dx == 0:
            return own
        pair = ("shiftrightunsigned", "shiftleft") if dx > 0 else ("shiftleft", "shiftrightunsigned")
        return F.when(F.col("_tx").isNull(), own).otherwise(_shift(pair[0], own, SIDE).bitwiseOR(_shift(pair[1], side, SIDE * SIDE - SIDE)))

    def towards(name: str, dx: int, dy: int) -> Column:
        own = across(name, dx, 0)
        if dy == 0:
            return own
        pair, inner, edge = (("shiftrightunsigned", "shiftleft"), 0x7F, 0x80) if dy > 0 else (("shiftleft", "shiftrightunsigned"), 0xFE, 0x01)
        every = lambda byte: _bits(byte * 0x0101010101010101)
        moved = _shift(pair[0], own, 1).bitwiseAND(every(inner)).bitwiseOR(_shift(pair[1], across(name, dx, dy), SIDE - 1).bitwiseAND(every(edge)))
        return F.when(F.col("_ty").isNull(), own).otherwise(moved)

    return met.select(*wafer, "_tx", "_ty", F.col(at(_SEEN, 0, 0)).alias("_own"), *[towards(name, *hop).alias(f"{name}{i}") for name in (_SEEN, _BAD) for i, hop in enumerate(NEIGHBOURS)])


def _counts(bit: Column) -> list[Column]:
    """Neighbours and bad neighbours of the position at ``bit`` of a tile's maps."""
    count = lambda name: sum((_shift("shiftrightunsigned", F.col(f"{name}{i}"), bit).bitwiseAND(F.lit(1)) for i in range(len(NEIGHBOURS))), F.lit(0).cast("long"))
    return [count(_SEEN).alias("neighbours"), count(_BAD).alias("bad_neighbours")]


def _whole(dies: DataFrame, *axes: str) -> bool:
    return all(isinstance(dies.schema[c].dataType, IntegralType) for c in axes)


def _states(dies: DataFrame, wafer: Sequence[str], x: str, y: str, is_pass: str, order: Sequence[str]) -> DataFrame:
    last = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return dies.groupBy(*wafer, x, y).agg(F.max_by(is_pass, last).alias("_pass"))


def neighbour_join(dies: DataFrame, wafer: Sequence[str] = ("wafer",), *, x: str = "x", y: str = "y", is_pass: str = "is_pass", order: Sequence[str] = ("row",)) -> DataFrame:
    """Counts of present and bad neighbours at every die position.

    No self-join: whole-numbered positions meet as maps of 8 by 8, which are sent to the maps around them, so a wafer with
    most of the dies is spread over its tiles. Other positions send their final state to their eight neighbours and
    themselves, and one aggregation per (wafer, x, y) collects them. On repeated coordinates the later row is the
    neighbour state.
    """
    state = _states(dies, wafer, x, y, is_pass, order)
    if _whole(dies, x, y):
        place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda b: _shift("shiftrightunsigned", F.col("_own"), b).bitwiseAND(F.lit(1)) == 1))
        found = _tile_maps(state, wafer, x, y).withColumn("_bit", place)
        inside = {x: ("_tx", F.floor(F.col("_bit") / SIDE)), y: ("_ty", F.col("_bit") % SIDE)}
        spot = [(F.col(t) * SIDE + b).cast((dies.schema[c].dataType)).alias(c) for c, (t, b) in inside.items()]
        return found.select(*wafer, *spot, *_counts(F.col("_bit")))
    hops = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *NEIGHBOURS]]
    sent = state.withColumn("_hop", F.explode(F.array(*hops)))
    away = (F.col("_hop.dx") != 0) | (F.col("_hop.dy") != 0)
    landed = sent.select(
        *wafer, (F.col(x) + F.col("_hop.dx")).alias(x), (F.col(y) + F.col("_hop.dy")).alias(y),
        away.alias("_away"), (away & ~F.col("_pass")).alias("_bad"),
    )
    met = landed.groupBy(*wafer, x, y).agg(
        F.count_if("_away").alias("neighbours"), F.count_if("_bad").alias("bad_neighbours"), F.count_if(~F.col("_away")).alias("_here")
    )
    return met.filter("_here > 0").drop("_here")


def gdbn_flag(is_pass: Column, neighbours: Column, bad: Column) -> Column:
    """A good die with at least four neighbours of which at least three quarters are bad."""
    return is_pass & (neighbours >= 4) & (bad >= 0.75 * neighbours)


def gdbn(dies: DataFrame, wafer: Sequence[str] = ("wafer",), *, x: str = "x", y: str = "y", is_pass: str = "is_pass", order: Sequence[str] = ("row",)) -> DataFrame:
    """Every die with its neighbour counts and the good-die-in-bad-neighbourhood flag."""
    if _whole(dies, x, y):
        # A die reads its counts off its tile's maps, so positions are not spelled out first; maps are hashed, dies not sorted.
        maps = _tile_maps(_states(dies, wafer, x, y, is_pass, order), wafer, x, y).hint("shuffle_hash")
        met = dies.withColumns({"_tx": _tile(x), "_ty": _tile(y)}).join(maps, [*wafer, "_tx", "_ty"])
        rest = [c for c in dies.columns if c not in (*wafer, x, y)]
        out = met.select(*wafer, x, y, *rest, *_counts(_bit(F.col(x), F.col(y))))
    else:
        out = dies.join(neighbour_join(dies, wafer, x=x, y=y, is_pass=is_pass, order=order), [*wafer, x, y])
    return out.withColumn("gdbn_flag", gdbn_flag(F.col(is_pass), F.col("neighbours"), F.col("bad_neighbours")))


def _box(dies: DataFrame, wafer: Sequence[str], x: str, y: str) -> DataFrame:
    """The extremes of each wafer's dies, counted: few are broadcast, so that a wafer's dies need not meet."""
    return measured(dies.groupBy(*wafer).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")))


def edge_fails(dies: DataFrame, wafer: Sequence[str] = ("wafer",), *, x: str = "x", y: str = "y", is_pass: str = "is_pass", margin: int = 2, box: DataFrame | None = None) -> DataFrame:
    """Dies with a flag for failing within ``margin`` units of the wafer's extremes."""
    box = _box(dies, wafer, x, y) if box is None else box
    near = (
        (F.col(x) <= F.col("_x0") + margin) | (F.col(x) >= F.col("_x1") - margin)
        | (F.col(y) <= F.col("_y0") + margin) | (F.col(y) >= F.col("_y1") - margin)
    )
    out = dies.join(box, list(wafer))
    return out.withColumn("edge_fail", near & ~F.col(is_pass)).drop("_x0", "_x1", "_y0", "_y1")


def spatial_summary(dies: DataFrame, wafer: Sequence[str] = ("wafer",), *, x: str = "x", y: str = "y", is_pass: str = "is_pass", order: Sequence[str] = ("row",)) -> DataFrame:
    """Die counts, fail density, neighbourhood risk and edge fails per wafer."""
    # The dies of ``gdbn`` are those with a wafer and a place; their extremes need no counts of neighbours.
    box = _box(dies.dropna(subset=[*wafer, x, y]), wafer, x, y)
    flagged = edge_fails(gdbn(dies, wafer, x=x, y=y, is_pass=is_pass, order=order), wafer, x=x, y=y, is_pass=is_pass, box=box)
    good, risk, total = F.count_if(F.col(is_pass)), F.count_if("gdbn_flag"), F.count(F.lit(1))
    sums = flagged.groupBy(*wafer).agg(
        total.alias("total_dies"), good.alias("good_dies"), risk.alias("gdbn_count"), F.count_if("edge_fail").alias("edge_fail_count")
    )
    return sums.withColumns(
        {
            "fail_density": (F.col("total_dies") - F.col("good_dies")) / F.col("total_dies"),
            "gdbn_ratio_all": F.col("gdbn_count") / F.col("total_dies"),
            "gdbn_rate_good": F.coalesce(F.col("gdbn_count") / F.nullif(F.col("good_dies"), F.lit(0)), F.lit(0.0)),
        }
    )


def wafer_map(flagged: DataFrame, *, is_pass: str = "is_pass") -> DataFrame:
    """Dies of ``gdbn`` with their display status."""
    return flagged.withColumn("status", wafer_status(F.col(is_pass), F.col("gdbn_flag")))


def wafer_map_counts(flagged: DataFrame, wafer: Sequence[str] = ("wafer",), *, is_pass: str = "is_pass") -> DataFrame:
    """Status counts and yield percentage per wafer."""
    s = F.col("status")
    return wafer_map(flagged, is_pass=is_pass).groupBy(*wafer).agg(
        F.count(F.lit(1)).alias("dies"), F.count_if(s == "Pass").alias("pass_dies"), F.count_if(s == "Fail").alias("fail_dies"),
        F.count_if(s == "GDBN Risk").alias("gdbn_dies"), (100 * F.count_if(s == "Pass") / F.count(F.lit(1))).alias("yield_pct"),
    )
