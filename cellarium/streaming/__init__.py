"""Event-time aggregates."""
