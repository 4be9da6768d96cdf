"""Queries over the driver tables, with the SQL that checks them, and scans of config files."""

from . import asof_tables, corner_scans, report_tables, scan_tables, sql_scans, tables

QUERIES = tables.QUERIES | scan_tables.QUERIES | sql_scans.QUERIES | asof_tables.QUERIES | corner_scans.QUERIES | report_tables.QUERIES
SQL = tables.SQL | scan_tables.SQL | sql_scans.SQL | asof_tables.SQL | corner_scans.SQL | report_tables.SQL

__all__ = ["QUERIES", "SQL"]
