"""Queries over the driver's tables, one or more an operator, each with its SQL where SQL can say the same."""

from . import answers, evaluation, graphs, resolution, searches, tables  # noqa: F401
