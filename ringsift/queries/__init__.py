"""Registered queries over the driver's tables, each with its SQL twin where one exists."""

from .registry import ORACLES, QUERIES, load_all

load_all()

__all__ = ["ORACLES", "QUERIES"]
