"""Raw logs and rate tables into canonical tables, and exports."""
