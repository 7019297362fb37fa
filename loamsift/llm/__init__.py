"""Operators for preparing training data, their queries and their SQL.

Nothing outside this subpackage imports it; ``queries`` holds what the driver runs.
"""
