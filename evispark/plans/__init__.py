"""Plan helpers: lineage cuts, size-checked broadcasts, unique row choice."""

from evispark.plans.lineage import cut_lineage, staged
from evispark.plans.sizes import broadcast_if_small, rows_up_to

__all__ = ["broadcast_if_small", "cut_lineage", "rows_up_to", "staged"]
