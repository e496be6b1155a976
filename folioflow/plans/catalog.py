"""All queries of the core; importing this fills the registry."""

from folioflow.plans import dates, documents, editing, invariants, library, records, sequences, texts
from folioflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "dates", "documents", "editing", "invariants", "library", "records", "sequences", "texts"]
