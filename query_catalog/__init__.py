"""The registered queries, their inputs and the SQL that checks them."""

from .oracles import ORACLES
from .queries import COVERAGE, QUERIES

__all__ = ["COVERAGE", "ORACLES", "QUERIES"]
