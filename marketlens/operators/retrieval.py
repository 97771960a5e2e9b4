"""Document text: page assembly, chunks, embeddings, nearest vectors, context and prompts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.vectors import pad_vector
from marketlens.operators.ranked import top_k
from marketlens.operators.vector_blocks import HITS, best, merge, topk_blocks, unit_rows

# The scoring functions are sent with the tasks, so that workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Chunk size and overlap in characters, and the stored vector width.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 400
VECTOR_WIDTH = 1536
# Fixed value: stands for a page without text.
EMPTY_PAGE = "[Unable to extract text from this page]"

# Vectors of one broadcast, and of one block of the shuffled form.
BROADCAST_QUERIES = 4096
BLOCK_VECTORS = 8192


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Text of each document from pages(doc, page_no, text) in page order, without separators.

    A document's text is one value of the result, so its pages have to meet in one row.
    """
    shown = F.when(F.coalesce(F.col("text"), F.lit("")) == "", EMPTY_PAGE).otherwise(F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("page_no", shown.alias("text"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


def chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                block: int = 512) -> DataFrame:
    """Chunks of the assembled text, straight from pages(doc, page_no, text).

    The same result as `chunk_text(assemble_pages(pages))`, but no document is put
    together: each page is cut into its share of the chunks it touches, and a chunk
    gathers at most `size` characters. Page offsets come from sums per block of pages,
    so a long document is spread over tasks. `page_no` is unique and counts from any start.
    """
    step = size - overlap
    shown = F.when(F.coalesce(F.col("text"), F.lit("")) == "", EMPTY_PAGE).otherwise(F.col("text"))
    sized = pages.select("doc", "page_no", shown.alias("text")).withColumns({
        "_len": F.length("text").cast("long"), "_block": F.floor(F.col("page_no") / block),
    })
    ahead = Window.partitionBy("doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("doc", "_block").agg(F.sum("_len").alias("_sum"))
    blocks = blocks.select("doc", "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("doc", "_block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("_ahead", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
        .join(blocks, ["doc", "_block"])
        .withColumn("_at", F.col("_from") + F.col("_ahead"))
    )
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - size) / step) + 1)
    last = F.floor((F.col("_at") + F.col("_len") - 1) / step)
    cut = placed.select("doc", "_at", "_len", "text", F.explode(F.sequence(first, last)).alias("chunk_no"))
    start = F.greatest(F.col("chunk_no") * step - F.col("_at"), F.lit(0))
    end = F.least(F.col("chunk_no") * step + size - F.col("_at"), F.col("_len"))
    piece = F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", piece.alias("piece"))))
    chunks = cut.groupBy("doc", "chunk_no").agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text")
    )
    name = F.concat_ws("_chunk_", F.col("doc").cast("string"), F.col("chunk_no").cast("string"))
    return chunks.select(name.alias("chunk_id"), "doc", "chunk_no", "text")


def chunk_text(docs: DataFrame, doc: str = "doc", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping character chunks with ids `<doc>_chunk_<i>`; an empty text has none."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    pieces = F.transform(starts, lambda at: F.substring(F.col("text"), at + 1, F.lit(size)))
    chunks = docs.where(F.length("text") > 0).select(doc, F.posexplode(pieces).alias("chunk_no", "text"))
    return chunks.select(
        F.concat_ws("_chunk_", F.col(doc).cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        doc, "chunk_no", "text",
    )


def spread(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """The same rows dealt over all tasks by id and text, however few row groups they are stored in."""
    return docs.repartition(F.xxhash64(doc, "text"))


def fit_embedder(chunks: DataFrame, width: int = 768) -> PipelineModel:
    """Hashed TF-IDF of unit length: a local stand-in for a hosted embedding model."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(chunks)


def embed_text(chunks: DataFrame, embedder: PipelineModel | Callable[[Column], Column],
               width: int | None = VECTOR_WIDTH) -> DataFrame:
    """Add an `embedding` array. `embedder` is a fitted model, or a function from the text column to
    an array column (for instance a pandas UDF around a hosted model)."""
    if isinstance(embedder, PipelineModel):
        hidden = ["_words", "_tf", "_tfidf", "_unit"]
        out = embedder.transform(chunks).withColumn("embedding", vector_to_array("_unit", "float32")).drop(*hidden)
    else:
        out = chunks.withColumn("embedding", embedder(F.col("text")))
    return out if width is None else out.withColumn("embedding", pad_vector(F.col("embedding"), width))


def vector_upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id",
                  replace_docs: str | None = None) -> DataFrame:
    """Keyed upsert of batches with a `batch_no`: the last write of each id wins.

    `replace_docs` names a document column: stored rows of documents that come in
    again are then dropped first, so that no stale tail chunks stay.
    """
    kept = stored
    if replace_docs:
        kept = stored.join(incoming.select(replace_docs).distinct(), replace_docs, "left_anti")
    values = [c for c in stored.columns if c not in (key, "batch_no")]
    order = [F.desc("batch_no"), *[F.asc_nulls_last(F.col(c).cast("string")) for c in values]]
    return top_k(kept.unionByName(incoming), [key], order, 1)


def _topk_broadcast(queries: pd.DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(
        (queries["query_id"].to_numpy(), unit_rows(queries["embedding"]))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        kept = None
        for batch in batches:
            if len(batch):
                hits = best(ids, matrix, batch, k)
                kept = hits if kept is None else merge([kept, hits], k)
        if kept is not None:
            yield kept

    # Each task sends on at most k rows per query, whatever it reads.
    return corpus.select("vec_id", "embedding").mapInPandas(scan, HITS)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 5,
                broadcast_limit: int = BROADCAST_QUERIES, block: int = BLOCK_VECTORS) -> DataFrame:
    """Exact k nearest vectors by cosine (rounded to 6 digits, ties by id) for each query.

    `queries(query_id, embedding)`, `corpus(vec_id, embedding)`; ids are unique. Up to `broadcast_limit`
    queries are sent to the tasks that scan the corpus, which is then not shuffled. More
    queries are matched block by block, and a query skips the blocks that cannot hold one of its k nearest
    (`vector_blocks`). Both ways score with matrix products and only emit the best k per query and task.
    """
    asked = queries.select("query_id", "embedding")
    some = asked.limit(broadcast_limit + 1).toArrow()
    if some.num_rows <= broadcast_limit:
        if not some.num_rows:
            return corpus.sparkSession.createDataFrame([], HITS + ", rank int")
        hits = _topk_broadcast(some.to_pandas(), corpus, k)
    else:
        hits = topk_blocks(asked, corpus, k, block)
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, rank="rank")


def rag_context(hits: DataFrame, chunks: DataFrame, separator: str = "\n") -> DataFrame:
    """Context text per query: the texts of its hits in rank order. A blank context fails the query.

    `hits(query_id, vec_id, rank)` hold at most k rows per query, `chunks(vec_id, text)`.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    joined = F.array_join(F.transform(ordered, lambda r: r["text"]), separator)
    context = hits.join(chunks, "vec_id").groupBy("query_id").agg(joined.alias("context"))
    blank = F.raise_error(F.concat(F.lit("no context for query "), F.col("query_id").cast("string")))
    return context.withColumn(
        "context", F.when(F.trim("context") == "", blank.cast("string")).otherwise(F.col("context"))
    )


def build_prompt(rows: DataFrame, question: str = "question", context: str = "context") -> DataFrame:
    """Prompt text from a context and a question column."""
    filled = F.format_string(
        "Answer the question from the filing excerpts below, in detail, and end with a short summary.\n"
        "Excerpts:\n%s\nQuestion:\n%s\nAnswer:\n",
        F.col(context), F.col(question),
    )
    return rows.withColumn("prompt", filled)


def news_prompts(articles: DataFrame, question: str, stock: str, per_prompt: int = 100) -> DataFrame:
    """Prompts over all distinct articles of a stock, about `per_prompt` to a prompt, as JSON lists, newest first.

    A model's input is limited, so articles are spread over as many prompts as they need.
    """
    columns = ["published_at", "headline", "summary", "custom_sentiment_score", "custom_sentiment_label"]
    distinct = articles.select(*columns).distinct()
    count = distinct.agg(F.count(F.lit(1)).alias("n")).scalar()
    parts = F.greatest(F.ceil(count / per_prompt), F.lit(1))
    listed = F.to_json(F.sort_array(F.collect_list(F.struct(*columns)), asc=False))
    grouped = (
        distinct.withColumn("prompt_no", F.pmod(F.xxhash64(*columns), parts))
        .groupBy("prompt_no").agg(listed.alias("articles"), F.count(F.lit(1)).alias("n_articles"))
    )
    template = "Stock: %s\nNews articles: %s\nQuestion: %s\n"
    text = F.format_string(template, F.lit(stock), F.col("articles"), F.lit(question))
    return grouped.select("prompt_no", "n_articles", text.alias("prompt"))
