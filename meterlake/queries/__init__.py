"""All registered queries of the engine."""

from meterlake.queries import reports, rollups, sequences, stored, transcripts
from meterlake.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "reports", "rollups", "sequences", "stored", "transcripts"]
