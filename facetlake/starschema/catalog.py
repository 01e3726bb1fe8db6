"""Imports every query module, so that the registry is complete."""

from facetlake.starschema import (  # noqa: F401
    fleet_queries,
    mesh_queries,
    part_queries,
    photo_queries,
    stream_queries,
    view_queries,
    volume_queries,
)
from facetlake.starschema.registry import QUERIES

__all__ = ["QUERIES"]
