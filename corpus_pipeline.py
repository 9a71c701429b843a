"""The corpus pipeline (see ``scriptmend.llm.pipeline``): STAGES, ORACLE_SQL and run."""

from scriptmend.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
