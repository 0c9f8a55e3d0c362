"""Expected levels of new designs: an incremental job over a growing table of texts.

Each text is a design: its letters, mapped to bases, are cut into k-mers, and the k-mers' levels are looked up in the k-mer table. One
row for each text tells how many k-mers it has, how many of them the table knows, and the mean levels before and after a step, so that
designs that the table doesn't cover are seen before anything is measured.

    python jobs/design_levels.py --config jobs/design_levels.json --documents PATH --parts PATH --output PATH

Takes the files that have come since the last run (a file stream with a checkpoint under the output), and writes
`levels/batch=N/status=...`. A batch that runs again overwrites its own folder, so that nothing is written twice.
"""

from __future__ import annotations

import argparse
import logging

if __name__ == "__main__":
    import _common

    _common.importable()

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators import lut
from sigspark.plans.catalogue import KMERS
from sigspark.sources import fixtures

log = logging.getLogger("jobs.design_levels")

#: files_per_batch: input files of a batch. k: letters of a k-mer, as in the table. least_known: share of known k-mers from which a
#: design is `covered`.
DEFAULTS = {"files_per_batch": 1000, "k": 6, "least_known": 0.4}

SCHEMA = "doc_id long, n_letters long, n_kmers long, n_known long, pre_mean double, post_mean double, batch int, status string"


def levels(documents: DataFrame, kmers: DataFrame, config: dict) -> DataFrame:
    """One row for each row of documents: `short` (fewer letters than k; a null text has none), `covered` or `uncovered`."""
    designs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fixtures.bases("text"), F.lit("")).alias("template"))
    found = lut.template_levels(designs, kmers, "doc_id", k=config["k"])
    status = F.when(F.col("n_kmers") == 0, "short").when(F.col("n_known") >= config["least_known"] * F.col("n_kmers"), "covered").otherwise("uncovered")
    return found.select("doc_id", "n_letters", "n_kmers", "n_known", "pre_mean", "post_mean", status.alias("status"))


def run(spark: SparkSession, config: dict, documents: str, parts: str, output: str) -> list[int]:
    """Takes what is new in the folder (or file) `documents`; returns the numbers of the batches it has written."""
    kmers = fixtures.kmer_levels(spark.read.parquet(parts))
    written = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{output}/levels/batch={number}"
        levels(batch, kmers, config).write.mode("overwrite").partitionBy("status").parquet(path)
        written.append(number)

    # as a pattern, which may name a single file, too
    pattern = documents if set("*?[{") & set(documents) else f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern)
    query = stream.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        log.info("nothing new in %s", documents)
    for r in read(spark, output).where(F.col("batch").isin(written)).groupBy("batch", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_kmers").alias("kmers")).orderBy("batch", "status").collect():
        log.info("batch %d of %s: %d designs %s, %d k-mers; written to %s/levels", r["batch"], documents, r["n"], r["status"], r["kmers"], output)
    return written


def read(spark: SparkSession, output: str) -> DataFrame:
    """All rows written so far; none before the first batch."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{output}/levels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


SQL = f"""
WITH {KMERS},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{"ACGT" * 6}AC'), '') AS template FROM documents),
w AS (SELECT r, unnest(list_transform(range(1, length(template) - {DEFAULTS["k"]} + 2), lambda i: substr(template, i, {DEFAULTS["k"]}))) AS kmer FROM d),
f AS (SELECT r, count(*) AS n_kmers, count(pre_mean) AS n_known, round(avg(pre_mean), 6) AS pre_mean, round(avg(post_mean), 6) AS post_mean FROM w LEFT JOIN k USING (kmer) GROUP BY r)
SELECT doc_id, length(template) AS n_letters, coalesce(n_kmers, 0) AS n_kmers, coalesce(n_known, 0) AS n_known, pre_mean, post_mean,
       CASE WHEN n_kmers IS NULL THEN 'short' WHEN n_known >= {DEFAULTS["least_known"]} * n_kmers THEN 'covered' ELSE 'uncovered' END AS status
FROM d LEFT JOIN f USING (r)"""


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="JSON file of settings")
    for name in ("documents", "parts", "output"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(arguments)
    from jobs import _common

    spark = _common.session("design_levels")
    try:
        run(spark, _common.settings(spark, a.config, DEFAULTS), a.documents, a.parts, a.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
