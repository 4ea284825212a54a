"""Queries over the given test tables, each with its SQL equivalent where there is one."""
