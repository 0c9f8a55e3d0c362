"""From raw documents to token ids: language, near duplicates, repeated passages, contamination, encoding."""

from sigspark.llm._shared import new_path
from sigspark.llm.pipeline import STAGES as STAGES

#: No stage but the last two can be said in SQL: learnt language model, similarity components, hashed sentence spans.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows that the stages leave of documents, one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
