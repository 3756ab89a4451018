"""Whole-table jobs and queries: Silver rebuild, record browse, inventory."""
