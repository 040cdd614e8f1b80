"""From raw documents to packed sequences: language, quality, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four
return rows of ``documents``; the last returns the pieces of the kept documents with their places.

Defined cases: a null, empty or letterless text goes with the first stage, and so does one whose two likeliest
languages the learned model cannot tell apart; without labels for quality, or
without a row that names its language, the stage that would learn from them keeps what it cannot judge
(every score is 0.5, and every text with a letter stays); of rows that repeat, whatever their ids, one stays;
a null id is kept like others; texts of any length are read whole; an empty table gives an empty result;
columns besides those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from gridloom.llm import exact_dedup, language_id, near_dedup, packing, quality
from gridloom.llm.bpe_ids import vocabulary
from gridloom.shared import materialize


def identify_language(spark, docs, sf_dir):
    """Documents go in which no language can be recognised (no text, no letter in it, or two languages fit about as well)."""
    return language_id.keep_identified(spark, docs, sf_dir)


def judge_quality(spark, docs, sf_dir):
    """Documents go whose score says that their label would be 0."""
    return quality.keep_good(spark, docs, sf_dir)


def drop_copies(spark, docs, sf_dir):
    """Of documents equal but for the case of A-Z the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8 or more of five-word shingles the smallest id stays."""
    return near_dedup.keep_one(docs, size=5)


def pack(spark, docs, sf_dir):
    """Kept documents as ids, cut and packed into sequences of 4096."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Learned stages and packing have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
