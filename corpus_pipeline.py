"""Documents to token identifiers: the stages, and ``run`` that applies them; they are defined in the subpackage of their operators."""

from lexisift.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
