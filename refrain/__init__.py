"""refrain: catalogue linkage, curation and browsing as Spark DataFrame operators.

The public surface is plain functions: Column -> Column in ``refrain.functions``,
DataFrame -> DataFrame in ``refrain.operators``, readers and writers in
``refrain.sources``, whole jobs in ``refrain.plans``, Structured Streaming forms in
``refrain.streaming``.
"""

from refrain.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
