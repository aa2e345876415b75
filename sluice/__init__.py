"""sluice: Spark-native data work for an LLM gateway.

Document ingestion and chunking, vector retrieval, text safety, usage
analytics and cache analytics, written as plain functions from DataFrames
to DataFrames (batch and Structured Streaming).
"""

from sluice.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
