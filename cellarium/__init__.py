"""Spreadsheet formulas, tabular dashboards and commercial audits as Spark plans."""
