"""The corpus pipeline of docquarry.llm.pipeline, under the name that its callers know. It goes with docquarry/llm."""

from docquarry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
