"""From raw documents to token ids: language, exact and near copies, the mix, the encoding.

Every stage takes and returns all columns of documents, whatever else they are called, but the last, which keeps doc_id, lang
and source. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import delete_path, documents, path_exists, shared_folder, shared_path
from vulnlake.llm.exact_dedup import exact_dedup
from vulnlake.llm.langid import fit_dictionaries, identify, training_rows
from vulnlake.llm.mixing import mixed_documents
from vulnlake.llm.near_dedup import near_duplicates
from vulnlake.llm.sentencepiece_codec import encode_documents, load_codec


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart from all others.

    Null, empty and letterless texts go, and so do texts between two languages; rows without a label are judged, not
    learned from. Repeated rows share a fate. Without a labelled row nothing is learned, so everything goes.
    """
    return identify(docs, fit_dictionaries(training_rows(docs))).where(~F.col("rejected")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same normalised text, the one with the smallest id.

    Null and empty texts are one text. Of repeated rows one stays; a null id stays only among null ids.
    """
    return exact_dedup(docs, with_text=True).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id.

    Texts without a word are nobody's copy. Rows that share an id share a fate, null ids too: they are taken for one document.
    """
    stay = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__stays"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__stays"]), "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, once for each time.

    Null is a source of its own. Documents without a word go, as nothing of them is taken; repeated rows count each.
    """
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, language and source with the ids of the pieces of each text; a null text has none."""
    return encode_documents(docs, load_codec(public_tokenizers.path("piece_bpe_32k.model")), keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("mix", mixed), ("sentencepiece", encoded)]

#: Compression and encoding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The stages in their order, each written to the shared folder and read again; its folder goes when the next one is written.

    A run with a ``run_id`` has folders of its own: started again under it, it goes on behind the last stage that was written whole.
    """
    base = shared_path(spark, "corpus") if run_id is None else f"{shared_folder(spark)}/corpus-{run_id}"
    paths = [f"{base}/{number}-{name.replace(' ', '-')}" for number, (name, _) in enumerate(STAGES)]
    done = max((i for i, p in enumerate(paths) if run_id is not None and path_exists(spark, f"{p}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else documents(spark, sf_dir)
    for number in range(done + 1, len(STAGES)):
        STAGES[number][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[number])
        docs = spark.read.parquet(paths[number])
        if number:
            delete_path(spark, paths[number - 1])
    return docs
