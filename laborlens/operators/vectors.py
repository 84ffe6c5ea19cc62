"""Embedding index, exact vector search and retrieval context."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.labels import similarity
from laborlens.functions.text import clean_text, terms
from laborlens.operators import inverted
from laborlens.operators.filters import fresh, is_expired


# --- embedding --------------------------------------------------------------------------

def hashing_embed(df: DataFrame, text: str, out: str = "embedding", dims: int = 256,
                  prefix: str = "passage: ") -> DataFrame:
    """Default embedding without a model: hashed term counts scaled to length one."""
    tokens = df.withColumn("_t", terms(clean_text(F.concat(F.lit(prefix), F.col(text)))))
    counted = HashingTF(inputCol="_t", outputCol="_tf", numFeatures=dims).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return (unit.withColumn(out, vector_to_array("_unit", "float32"))
            .drop("_t", "_tf", "_unit"))


# --- index maintenance ------------------------------------------------------------------

def not_indexed(documents: DataFrame, index: DataFrame, key: str = "posting_id") -> DataFrame:
    """Documents whose id the index does not hold yet."""
    return documents.join(index.select(key), key, "left_anti")


def prune_expired(index: DataFrame, postings: DataFrame, as_of=None) -> DataFrame:
    """The index without postings that are past the freshness window."""
    gone = postings.where(is_expired(as_of)).select("posting_id")
    return index.join(gone, "posting_id", "left_anti")


def index_additions(documents: DataFrame, index: DataFrame, as_of=None, reindex: bool = False,
                    embed=hashing_embed) -> DataFrame:
    """(posting_id, embedding, document, meta) of fresh postings that are to be added.

    ``documents`` holds posting_id, document, meta, posted_at and scraped_at;
    ``embed(df, text_column)`` adds the embedding column.
    """
    rows = fresh(documents, as_of)
    if not reindex:
        rows = not_indexed(rows, index)
    return embed(rows, "document").select("posting_id", "embedding", "document", "meta")


# --- search -----------------------------------------------------------------------------

def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 4,
                block: int = inverted.QUERY_BLOCK) -> DataFrame:
    """(query_id, item_id, distance, rank): the k nearest items by cosine distance, exact.

    The corpus (item_id, embedding) is laid out as inverted lists for this call; keep
    ``inverted.build_lists`` where many searches share a corpus. Queries have query_id and
    embedding; a row without a usable vector is near nothing; a vector meets those of its length.
    """
    return inverted.search_lists(inverted.build_lists(corpus), queries, k, block)[0]


def search_questions(questions: DataFrame, corpus: DataFrame, k: int = 4, text: str = "text",
                     embed=hashing_embed) -> DataFrame:
    """(query_id, item_id, distance, rank) for questions (query_id, text), embedded as queries.

    ``embed(df, text_column, prefix=...)`` adds the embedding column, as for the corpus.
    """
    asked = embed(questions, text, prefix="query: ")
    return vector_topk(asked, corpus, k)


# --- retrieval context ------------------------------------------------------------------

def history_tail(turns: DataFrame, last: int = vocab.HISTORY_TURNS) -> DataFrame:
    """The last turns of each conversation; the limit is also applied before the shuffle."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (turns.withColumn("_n", F.row_number().over(w))
            .where(F.col("_n") <= last).drop("_n"))


def context_blocks(matches: DataFrame, documents: DataFrame,
                   below: float = vocab.MATCH_DISTANCE) -> DataFrame:
    """(query_id, context): matches nearer than ``below`` as numbered blocks, by rank."""
    score = similarity(F.col("distance"), 2)
    text = F.concat(F.lit("--- Matching Vacancy #"), F.col("rank").cast("string"),
                    F.lit(" (Semantic Match Score: "), score.cast("string"), F.lit(") ---\n"),
                    F.col("document"), F.lit("\n"))
    blocks = (matches.where(F.col("distance") < below)
              .join(documents.select("item_id", "document"), "item_id")
              .groupBy("query_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("b")))
    return blocks.select("query_id",
                         F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("context"))


def prompt_rows(messages: DataFrame, contexts: DataFrame, history: DataFrame,
                last: int = vocab.HISTORY_TURNS) -> DataFrame:
    """One row per question: context (or the fixed sentence), recent history, message.

    ``messages`` holds conv_id, query_id and message; ``history`` the turns before it.
    """
    tail = (history_tail(history, last).groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h")))
    lines = F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return (messages.join(contexts, "query_id", "left").join(tail, "conv_id", "left")
            .select("conv_id",
                    F.coalesce("context", F.lit(vocab.NO_CONTEXT)).alias("context"),
                    F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("history"),
                    "message"))
