"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each over all that its predecessor kept: quality rules drop
documents, the n-gram Jaccard join keeps one document of each group of near
duplicates, decontamination drops documents that hold a benchmark window,
secrets are masked, and what is left is packed into sequences. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize, table
from tessera.llm.decontaminate import decontamination_stage
from tessera.llm.jaccard import near_duplicate_stage
from tessera.llm.packing import packing_stage
from tessera.llm.quality import quality_stage
from tessera.llm.secrets import redaction_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", redaction_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted trees nor the tokenizer; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
