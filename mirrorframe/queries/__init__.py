"""The registered queries, each with DuckDB SQL where SQL can express it."""

from mirrorframe.queries import constraints, features, profiles, quality, structure, synthesis, texts
from mirrorframe.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "constraints", "features", "profiles", "quality", "structure", "synthesis", "texts"]
