"""Intermediate tables in the cluster's shared checkpoint folder."""

from sluice.session import write_table as materialise

__all__ = ["materialise"]
