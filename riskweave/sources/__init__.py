"""Readers for the two input tables."""

from .rejects import Loaded, load_checked, reject_summary
from .tables import (
    conform,
    dataset_check,
    load_merchants,
    load_transactions,
    read_jdbc,
    read_table,
)

__all__ = [
    "Loaded",
    "conform",
    "dataset_check",
    "load_checked",
    "load_merchants",
    "load_transactions",
    "read_jdbc",
    "read_table",
    "reject_summary",
]
