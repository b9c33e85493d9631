"""Relational operators: audit detectors, cleaning, long form, graphs."""
