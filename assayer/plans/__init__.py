"""Queries over the driver's tables, one for each operator, with the SQL that each must equal."""

from assayer.plans import areas, numeric, records, relational, selection, texts
from assayer.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "areas", "numeric", "records", "relational", "selection", "texts"]
