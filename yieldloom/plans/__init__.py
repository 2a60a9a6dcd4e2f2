"""Building blocks for plans that stay balanced when one key holds most of the rows."""

from yieldloom.plans.hot import HOT_ROWS, HotKeys, bounded, find_hot, measured, split_hot
from yieldloom.plans.ordered import nearby_rows, row_index, running_totals
from yieldloom.plans.quantiles import group_stats

__all__ = [
    "HOT_ROWS",
    "HotKeys",
    "bounded",
    "find_hot",
    "group_stats",
    "measured",
    "nearby_rows",
    "row_index",
    "running_totals",
    "split_hot",
]
