"""Queries over the model's tables; importing this package registers them all."""

from . import extra, joins, locations, media, mentions, more, search, sets, stats, streams, tail, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extra", "joins", "locations", "media", "mentions", "more", "search", "sets", "stats", "streams", "tail", "text"]
