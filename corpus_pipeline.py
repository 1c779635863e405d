"""Corpus pipeline over `documents`: quality rules, near-dedup, secret scans, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and is written and read again. As a stage begins,
the results of those before it have been written, so their intermediate tables are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm.common import materialize, release, tagged
from lodeframe.llm.mixing import mix
from lodeframe.llm.packing import pack
from lodeframe.llm.quality import keep_good
from lodeframe.llm.secrets import redact
from lodeframe.llm.simhash import keep_one

TAG = "pipeline"


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, TAG, docs)
        with tagged(TAG):
            return work(docs)

    return stage


STAGES = [
    ("quality", _stage(keep_good)),  # documents that the adaptive rules reject go
    ("near_dedup", _stage(keep_one)),  # one document of each group of near copies stays
    ("secrets", _stage(redact)),  # live-looking secrets are replaced in the texts; all documents stay
    ("mixing", _stage(mix)),  # a document is left out, taken once or taken twice, as its source's target asks
    ("packing", _stage(pack)),  # pieces of at most 1024 tokens, with their ids, sequence and place
]
#: SimHash, knapsack and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), uuid.uuid4().hex
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        with tagged(f"{own}-{k % 2}"):
            docs = materialize(done, name)
        release(spark, f"{own}-{(k + 1) % 2}")
    release(spark, TAG)
    return docs
