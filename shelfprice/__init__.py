"""Retail demand and pricing analytics expressed as Spark DataFrame jobs."""

from shelfprice.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
