"""Queries of whole memories: conversations as namespaces, their turns as events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import scratch_dir
from recallgrid.functions.vectors import quantize
from recallgrid.operators.capsules import BoundMemory, BoundSettings

from recallgrid.operators.latent import encoder
from recallgrid.operators.memory import Memory, Settings
from recallgrid.sources.artifacts import export_codes, read_codes
from recallgrid.sources.durable import EpisodeTable
from recallgrid.streaming.writes import streaming_edges

from .graph_queries import _shown_sql, codes, shown
from . import text_queries as TQ
from .registry import query, read

SMALL = BoundSettings(dimension=4096, topk=24, context_dimension=512, context_topk=16, binding_dimension=1024, address_topk=40, slots=4, max_degree=32, context_degree=16, rule="covariance", interval=10)


def turns(spark, d):
    """All turns as events: a namespace a conversation, a stream a role; turns without number or of one number follow by role and text."""
    rows = read(spark, d, "conversations").select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("ns"), "turn", F.coalesce("role", F.lit("")).alias("stream"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("seq", F.row_number().over(W.partitionBy("ns").orderBy("turn", "stream", "text")).cast("long"))
    meta = F.to_json(F.struct(F.col("stream").alias("role"), (F.col("stream") == "assistant").alias("assistant")))
    return placed.select("ns", F.concat(F.lit("t"), F.col("seq").cast("string")).alias("episode_id"), "seq", "text", "stream", meta.alias("metadata"))


@query("bound_write")
def bound_write(spark, d):
    """What the second engine holds of each conversation after its turns were written in order."""
    memory = BoundMemory(SMALL).write(turns(spark, d))
    told = memory.episodes.groupBy("ns").agg(F.count(F.lit(1)).alias("episodes"), quantize(F.avg("novelty")).alias("novelty"), quantize(F.avg("salience")).alias("salience"), F.sum("birth_score").alias("_b"))
    sized = lambda df, name: df.groupBy("ns").agg(F.count(F.lit(1)).alias(name), quantize(F.sum("w"), 4).alias(f"{name}_weight"))
    for df, name in ((memory.association, "associations"), (memory.temporal, "successions"), (memory.links, "links")):
        told = told.join(sized(df, name), "ns", "left")
    return told.drop("_b").fillna(0)


@query("streamed_edges", _shown_sql("hebb_edges_t", 8))
def streamed_edges(spark, d):
    """The Hebbian graph of the embeddings, learned by the streaming fold from two files of writes."""
    place = scratch_dir(spark, "streamed")
    packed = codes(spark, d).groupBy("ns", "seq").agg(F.sort_array(F.collect_list(F.struct("feature", "w"))).alias("code"))
    half = packed.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    for part in (packed.filter(F.col("seq") <= half), packed.filter(F.col("seq") > half)):
        part.coalesce(1).write.mode("append").parquet(f"{place}/in")
    return shown(streaming_edges(spark, f"{place}/in", place, packed.schema, rule="hebb", cap=False, max_degree=1 << 30), 8)


@query("durable_episodes", """SELECT CAST(doc_id AS VARCHAR) AS episode_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'new ' || coalesce(text, '') ELSE coalesce(text, '') END) AS digest,
    CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS entries FROM documents WHERE doc_id % 5 <> 0""")
def durable_episodes(spark, d):
    """All documents in the durable table after an upsert of all, one of a third, a delete of a fifth, with a compaction before it."""
    table = EpisodeTable(spark, scratch_dir(spark, "episodes"), buckets=16)
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("episode_id"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    code = lambda n: F.struct(F.lit(1024).alias("dimension"), F.array(*[(F.col("doc_id") % 97 + k).cast("int") for k in range(n)]).alias("indices"), F.array(*[F.lit(1.0)] * n).alias("values"))
    table.upsert(docs.withColumn("code", code(2)))
    table.upsert(docs.filter("doc_id % 3 = 0").withColumns({"text": F.concat(F.lit("new "), "text"), "code": code(1)}))
    table.compact()
    table.delete(docs.filter("doc_id % 5 = 0"))
    entries = table.postings().groupBy("episode_id").agg(F.count(F.lit(1)).alias("entries"))
    return table.all().join(entries, "episode_id", "left").select("episode_id", F.md5("text").alias("digest"), "version", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"))


@query("feature_artifact", f"SELECT event_id, feature, {TQ.Q('w')} AS w FROM text_codes")
def feature_artifact(spark, d):
    """Codes of all turns, exported as an artefact and read back by the precomputed encoder."""
    texts = TQ.turns(spark, d).select("event_id", "text").filter("text IS NOT NULL")
    folder = scratch_dir(spark, "features")
    export_codes(texts, encoder("hashing", dimension=TQ.DIM, k=TQ.TOP), TQ.DIM, folder)
    known = encoder("precomputed", features=read_codes(spark, folder, TQ.DIM))
    return known(texts, "event_id", "text").select("event_id", "feature", quantize(F.col("w")).alias("w"))


@query("memory_stats", """SELECT conv_id AS ns, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS postings, any_value(f) AS features FROM (
    SELECT conv_id, event_id, count(feature) AS n FROM turns LEFT JOIN text_codes USING (event_id) GROUP BY 1, 2)
    JOIN (SELECT conv_id, count(DISTINCT feature) AS f FROM turns LEFT JOIN text_codes USING (event_id) GROUP BY 1) USING (conv_id) GROUP BY 1""")
def memory_stats(spark, d):
    """Counts of a memory of the first engine, a namespace a conversation, after all turns were written."""
    memory = Memory(Settings(dimension=TQ.DIM, topk=TQ.TOP, rule="hebb")).write(turns(spark, d))
    return memory.stats().select("ns", "episodes", "postings", "features")
