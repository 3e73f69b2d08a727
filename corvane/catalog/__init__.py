"""Registered queries and the SQL each one must agree with."""

from corvane.catalog.registry import ORACLES, QUERIES
from corvane.catalog import answers, composites, corpus, crawling, documents, metrics, quality, sources, stateful, storage, streams, upkeep  # noqa: F401
