"""Every operator as a registered query over the test tables, most with a SQL twin."""

from lendframe.queries.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
