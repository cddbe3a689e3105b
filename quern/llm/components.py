"""Connected components of one edge table, by the keyed ones of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.operators.components import labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node reachable.

    Self-loops and repeated edges are ignored; an empty table gives no rows.
    """
    return labels(edges, [])
