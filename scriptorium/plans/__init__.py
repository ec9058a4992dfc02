"""Queries of the library over the shared tables."""

from scriptorium.plans import aggregates, boundaries, entities, graphs, joins, reader, review, scalars, scoring, search, segmentation, selection, windows  # noqa: F401
