"""Operators for training-data pipelines: packing, quality, deduplication, decontamination, counting.

Nothing else in the library imports this package.  ``flareframe.llm.queries`` registers each
operator over the given tables.
"""
