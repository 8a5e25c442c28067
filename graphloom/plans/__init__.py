"""Shared plan helpers: cutting lineage, connected components, numbering, joins with hot keys."""

from graphloom.plans.components import connected_components
from graphloom.plans.hot import join_hot
from graphloom.plans.lineage import cut, drop, shared_folder
from graphloom.plans.numbering import numbered

__all__ = ["connected_components", "cut", "drop", "join_hot", "numbered", "shared_folder"]
