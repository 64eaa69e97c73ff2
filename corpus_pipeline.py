"""A corpus pipeline: quality, exact dedup, near dedup, mixing, encoding.

Each stage takes what the one before it kept.  All but the last return the columns of ``documents``:
rejected rows and copies are gone, and rows that the mix takes several times are there as often.
The last returns a row of digests per document of the mix.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecensus.llm import quality
from pagecensus.llm.exact_dedup import deduplicated
from pagecensus.llm.mixing import mixed
from pagecensus.llm.near_dedup import representatives
from pagecensus.llm.queries import coded
from pagecensus.session import materialised


def keep_good(spark, docs, sf_dir):
    """Documents that the classifier does not reject; it is fitted on those of them with labels."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs, sf_dir):
    return deduplicated(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each component of five-word shingle links at 0.8 or more."""
    return representatives(docs)


def mix_sources(spark, docs, sf_dir):
    return mixed(docs, F.array("source"))


def encode_pieces(spark, docs, sf_dir):
    """Documents that the mix holds several times are cut differently each time."""
    return coded(spark, docs, numbered=True)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]
#: A fitted classifier, MinHash and merges are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialised(docs)
    return docs
