"""All registered queries; importing the package fills the registry."""

from clausegrid.catalog import econ, flows, frames, panel, segment, sources, spans, text, vectors  # noqa: F401
from clausegrid.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
