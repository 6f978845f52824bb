"""Corpus pipeline: toxicity, quality, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written
as Parquet to the shared checkpoint folder and read again, so a lost executor costs one stage.

All stages but the last return the columns of their input and drop rows, never change them.  Null and empty texts are judged as
texts without words: they are clean, share nothing with others and hold no benchmark item, so only the quality stage
may drop them.  Rows without an id pass the near-duplicate stage; of rows that repeat an id it keeps the first text in alphabetical order.
Repeated rows are judged alike.  Extra columns pass through, whatever their names, up to the encoding.  Texts are judged whole at any
length.  Empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimledger.llm.common import read_table, store, work_dir
from claimledger.llm.decontamination import drop_contaminated
from claimledger.llm.jaccard_join import one_of_each
from claimledger.llm.quality_pu import drop_low_quality
from claimledger.llm.sentencepieces import encode_stage
from claimledger.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_stage),
]

#: Trained stages cannot be written as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder, docs = work_dir(spark), read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, folder, f"stage-{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
