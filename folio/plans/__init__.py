"""Queries over the synthetic tables and the SQL that each must match."""

from . import contracts, controls, evidence, grid, layout, ledger, numbering, sources, template, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
