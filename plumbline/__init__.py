"""Data-quality and data-investigation operators for Spark DataFrames."""

from plumbline.sources.environment import Env, Link

__all__ = ["Env", "Link"]
