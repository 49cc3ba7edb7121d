"""Connected components, with the small Arrow batches that texts need."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geospan import components as general
from geospan.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, component``; see ``geospan.components``."""
    return general.components(edges, checkpointed)
