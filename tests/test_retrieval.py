import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.functions.vectors import pad_vector, slide
from marketlens.operators import retrieval as R
from marketlens.operators import vector_blocks
from marketlens.plans import jobs


@pytest.mark.parametrize("length,chunks", [(0, 0), (1, 1), (600, 1), (601, 2), (1000, 2), (1001, 2), (1201, 3)])
def test_chunk_counts(spark, length, chunks):
    text = "".join(chr(97 + i % 26) for i in range(length))
    rows = R.chunk_text(spark.createDataFrame([(7, text)], "doc int, text string")).orderBy("chunk_no").collect()
    assert [r["text"] for r in rows] == [text[i:i + 1000] for i in range(0, length, 600)]
    assert [r["chunk_id"] for r in rows] == [f"7_chunk_{i}" for i in range(chunks)]


def test_chunks_from_pages_equal_chunks_of_the_text(spark):
    lengths = [0, 5, 1700, 0, 600, 1, 999, 2500, 3, 0]
    pages = [(d, p, "".join(chr(97 + (i * 7 + p) % 26) for i in range(n * (d + 1) // 2)))
             for d in range(3) for p, n in enumerate(lengths)] + [(9, 0, None)]
    df = spark.createDataFrame(pages, "doc int, page_no int, text string").repartition(5)
    whole = R.chunk_text(R.assemble_pages(df)).select("chunk_id", "text")
    pieces = R.chunk_pages(df, block=3).select("chunk_id", "text")
    assert whole.exceptAll(pieces).count() == 0 and whole.count() == pieces.count() > 20
    assert R.assemble_pages(df).where("doc = 9").first()["text"] == R.EMPTY_PAGE


def test_padding(spark):
    def width(n):
        df = spark.range(1).select(F.array_repeat(F.lit(1.0).cast("float"), n).alias("v"))
        return df.select(pad_vector(F.col("v"))).first()[0]

    assert len(width(64)) == 1536 and width(64)[63:66] == [1.0, 0.0, 0.0] and len(width(1536)) == 1536
    with pytest.raises(Exception, match="exceeds"):
        width(1537)
    assert spark.range(1).select(slide(F.array(F.lit(1), F.lit(2)), F.lit(3))).first()[0] == [2, 3]


def vectors(spark, n, width=8, seed=0):
    rng = np.random.default_rng(seed)
    # Few distinct values make ties.
    data = rng.integers(0, 3, size=(n, width)).astype(float) + 0.1
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("limit,block", [(4096, 8192), (10, 16), (10, 1000)])
def test_topk_matches_brute_force(spark, limit, block):
    data, corpus = vectors(spark, 120)
    queries = corpus.where("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    hits = R.vector_topk(queries, corpus.repartition(5), 4, broadcast_limit=limit, block=block).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round(unit[:30] @ unit.T, 6)
    wanted = {(q, int(v), r + 1) for q in range(30) for r, v in enumerate(np.lexsort((np.arange(120), -scores[q]))[:4])}
    assert {(h["query_id"], h["vec_id"], h["rank"]) for h in hits} == wanted


@pytest.mark.parametrize("spread, block", [(0.05, 64), (0.05, 8), (3.0, 64)])
def test_queries_skip_blocks_out_of_reach(spark, spread, block):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 16))
    sizes = [200, *[20] * 18, 1]  # one cluster of several blocks, and one below k
    data = np.concatenate([m + spread * rng.normal(size=(n, 16)) / 4 for m, n in zip(middles, sizes)])
    data[5:9] = data[4]  # copies, which tie
    data[30] = 0
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    queries = corpus.where("vec_id % 3 = 0 or vec_id in (30, 560)").withColumnRenamed("vec_id", "query_id")
    hits = R.vector_topk(queries, corpus, 5, broadcast_limit=1, block=block).collect()
    norms = np.linalg.norm(data, axis=1, keepdims=True)
    unit = data / np.where(norms == 0, 1, norms)
    scores, n = np.round(unit @ unit.T, 6), len(data)
    asked = [r["query_id"] for r in queries.collect()]
    wanted = {(q, int(v), r + 1) for q in asked for r, v in enumerate(np.lexsort((np.arange(n), -scores[q]))[:5])}
    assert {(h["query_id"], h["vec_id"], h["rank"]) for h in hits} == wanted
    plan = vector_blocks.plan_rounds(queries, corpus, 5, block)
    met, blocks = plan.home.count() + plan.rest.count(), plan.blocks.select("block").distinct().count()
    assert plan.blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= 2 * block
    if spread < 1:
        assert met < len(asked) * blocks / 2


def nearest_by_hand(data, asked, k):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores, ids = np.round(unit[asked] @ unit.T, 6), np.arange(len(data))
    return {(q, int(v), r + 1) for i, q in enumerate(asked) for r, v in enumerate(np.lexsort((ids, -scores[i]))[:k])}


@pytest.mark.parametrize("block", [3, 8])
def test_vectors_are_sent_once_per_tile(spark, block):
    # Too far apart for blocks to be skipped; blocks of 3 hold less than k. A third are copies of one vector.
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1500, 24))
    data[rng.choice(1500, 500, replace=False)] = data[7]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(3)
    queries = corpus.withColumnRenamed("vec_id", "query_id")
    hits = R.vector_topk(queries, corpus, 5, broadcast_limit=1, block=block).collect()
    assert {(h["query_id"], h["vec_id"], h["rank"]) for h in hits} == nearest_by_hand(data, list(range(1500)), 5)
    plan = vector_blocks.plan_rounds(queries, corpus, 5, block)
    assert plan.blocks.select("block").distinct().count() > 100 and plan.rest.count() <= 4 * 1500


def test_tiles_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "TILE_BYTES", 16 * 8 * 50)
    monkeypatch.setattr(vector_blocks, "SCORED_ROWS", 7)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 16)) + 3 * rng.normal(size=(6, 16))[rng.integers(0, 6, 300)]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    queries = corpus.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    hits = R.vector_topk(queries, corpus, 5, broadcast_limit=1, block=10).collect()
    assert {(h["query_id"], h["vec_id"], h["rank"]) for h in hits} == nearest_by_hand(data, list(range(0, 300, 2)), 5)


def test_copies_beyond_k_are_left_out():
    rows = [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 0.0]), (1, [0.0, 1.0])]
    found = pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [np.array(v) for _, v in rows], "block": [0, 1, 0, 0]})
    assert sorted(vector_blocks.first_copies(found, 2)["vec_id"]) == [1, 2, 5]


def test_topk_of_little(spark):
    _, corpus = vectors(spark, 3)
    queries = corpus.withColumnRenamed("vec_id", "query_id")
    assert R.vector_topk(queries, corpus, 5).count() == 9
    assert R.vector_topk(queries.limit(0), corpus, 5).count() == 0


def test_upsert(spark):
    schema = "chunk_id string, doc string, text string, batch_no int"
    stored = spark.createDataFrame([("d_chunk_0", "d", "old", 1), ("d_chunk_1", "d", "tail", 1), ("e_chunk_0", "e", "e", 1)], schema)
    new = spark.createDataFrame([("d_chunk_0", "d", "new", 2)], schema)
    kept = {r["chunk_id"]: r["text"] for r in R.vector_upsert(stored, new).collect()}
    assert kept == {"d_chunk_0": "new", "d_chunk_1": "tail", "e_chunk_0": "e"}
    assert R.vector_upsert(stored, new, replace_docs="doc").count() == 2


def test_blank_context_fails(spark):
    hits = spark.createDataFrame([(1, 1, 1)], "query_id long, vec_id long, rank int")
    chunks = spark.createDataFrame([(1, "  ")], "vec_id long, text string")
    with pytest.raises(Exception, match="no context"):
        R.rag_context(hits, chunks).collect()


def test_pages_to_prompts(spark):
    topics = ["revenue growth cloud services", "netflix streaming subscribers", "gpu data center chips"]
    pages = spark.createDataFrame([(d, 0, (t + " ") * 20) for d, t in enumerate(topics)], "doc int, page_no int, text string")
    chunks, model = jobs.index_pages(pages)
    chunks = chunks.withColumn("vec_id", F.col("doc").cast("long"))
    asked = spark.createDataFrame([(1, "how many streaming subscribers")], "query_id long, question string")
    prompt = jobs.retrieve(asked, chunks, model, k=1).first()["prompt"]
    assert "netflix streaming" in prompt and "how many streaming" in prompt and "gpu" not in prompt


def test_embedder_function(spark):
    df = spark.createDataFrame([("ab",)], "text string")
    out = R.embed_text(df, lambda text: F.array(F.length(text).cast("float")), width=3)
    assert out.first()["embedding"] == [2.0, 0.0, 0.0]


def test_documents_of_one_file_are_embedded_by_many_tasks(spark, sf_dir):
    from marketlens.plans import document_queries, views

    plan = document_queries.embed_text(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64" in plan
    docs = views.documents(spark, sf_dir)
    assert sorted(map(str, R.spread(docs).collect())) == sorted(map(str, docs.collect()))
