"""The corpus pipeline: toxicity, near-duplicates, mixing, packing. Its stages are in segmill.llm.pipeline."""

from segmill.llm.pipeline import STAGES, drop_near_duplicates, drop_toxic, mix_sources, pack_sequences, run

#: The classifier and the tokens can't be expressed in SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "drop_near_duplicates", "drop_toxic", "mix_sources", "pack_sequences", "run"]
