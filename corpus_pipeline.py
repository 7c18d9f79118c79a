"""A training corpus from raw documents, in five stages (see freshet/llm/pipeline.py).

Each of STAGES takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from freshet.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
