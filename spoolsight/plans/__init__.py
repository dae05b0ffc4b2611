"""Canonical views over other tables, and the registered queries."""
