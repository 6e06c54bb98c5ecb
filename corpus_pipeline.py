"""The training-data pipeline: documents to packed batches. Its stages are in tarnwatch.llm.pipeline."""

from tarnwatch.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
