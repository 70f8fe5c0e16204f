"""Stage chains and the registry of named queries."""
