"""All queries over the catalogue, by their names."""

from atelier.queries import aggregates, calendar, geography, joins, quality, scalars, sources, streams
from atelier.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "calendar", "geography", "joins", "quality", "scalars", "sources", "streams"]
