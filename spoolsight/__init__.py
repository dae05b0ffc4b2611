"""Spark jobs over coding-agent activity logs."""
