"""Spreadsheet functions and the formula compiler."""
