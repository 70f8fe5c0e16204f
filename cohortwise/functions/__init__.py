"""Column-expression helpers: every function maps Columns to a Column.

They compile to Catalyst expressions (whole-stage codegen); no Python runs
per row.
"""
