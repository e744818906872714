"""Five stages over the documents table; each is written as Parquet and reread by the next.

Every stage takes the columns of documents, whatever other columns there are, and returns them as they are; the last one returns the shards. Null
texts fail the quality rules. Rows without a doc_id are judged by their own text in every stage, but are nobody's near copy. Rows that repeat a
doc_id are one document to the near copies: if one of their texts is a copy of a smaller id's, all of them go, else all stay; in
all other stages each row counts for itself. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pricewell.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from pricewell.llm.common import keep, last_kept, released, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_copies(spark, docs, sf_dir):
    """The document with the smallest id of every group of linked documents; rows without an id stay."""
    copies = ngram_join.similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(keep(copies, "copies"), "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark, docs, sf_dir):
    """Documents without passages of the benchmark."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents that the mixture takes: at most one epoch, four fifths of all tokens."""
    return mixing.take_once(docs.select(*COLUMNS), fraction=0.8)


def sharded(spark, docs, sf_dir):
    """Where each document goes."""
    return sharding.assign_shards(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
#: The learned rules, the numpy hashes and the CRC of the last stage are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``, each one's result written to the shared folder and reread; a stage's own intermediate tables go once it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with released(spark) as spared:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            spared.append(last_kept())
    return STAGES[-1][1](spark, docs, sf_dir)
