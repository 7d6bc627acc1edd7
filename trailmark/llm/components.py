"""Connected components of link tables, with every step stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trailmark.llm.common import stored
from trailmark.operators import components
from trailmark.operators.components import forest

__all__ = ["connected_components", "forest"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reached."""
    return components.connected_components(links, keep=stored)
