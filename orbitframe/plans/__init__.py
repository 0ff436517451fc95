"""Every query with its SQL twin; importing the package registers them all."""

from . import registry
from . import analysis, changes, decisions, grids, instances, optical, rulings, building_blocks  # noqa: I001  register on top of it

__all__ = ["analysis", "building_blocks", "changes", "decisions", "grids", "instances", "optical", "registry", "rulings"]
