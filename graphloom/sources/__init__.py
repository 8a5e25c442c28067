"""Graph store, and graphs derived from tables."""

from graphloom.sources.graph import PropertyGraph
from graphloom.sources.tables import directed_trade_graph, table, trade_graph, trade_paths

__all__ = ["PropertyGraph", "directed_trade_graph", "table", "trade_graph", "trade_paths"]
