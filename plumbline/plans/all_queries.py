"""Every registered query; importing the modules registers them."""

from plumbline.plans import q_compare, q_documents, q_history, q_links, q_mixed, q_rules, q_tables  # noqa: F401
from plumbline.plans.registry import QUERIES, callables, oracles

__all__ = ["QUERIES", "callables", "oracles"]
