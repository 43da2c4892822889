"""Queries on texts: tokens, codes, contexts, chunks, sessions and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.functions.lineage import settle
from recallgrid.functions.vectors import quantize
from recallgrid.operators import encode as E
from recallgrid.operators import store as S
from recallgrid.sources import sessions as SS

from .registry import cte, query, read, shared

DIM, TOP = 4096, 64


def turns(spark, d):
    return read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "conv_id", "turn", "role", "text")


ALIAS_SQL = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.ALIASES.items()) + " ELSE t END"
cte("turns", "SELECT conv_id * 1000 + turn AS event_id, conv_id, turn, role, text FROM conversations")
cte("tok", f"SELECT event_id, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda t: {ALIAS_SQL}) AS w FROM turns")
cte("grams", """SELECT event_id, 'w1:' || w[i] AS name FROM (SELECT event_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok)
    UNION ALL SELECT event_id, 'w2:' || w[i] || '_' || w[i + 1] FROM (SELECT event_id, w, unnest(range(1, len(w))) AS i FROM tok)""")
cte("gram_counts", "SELECT event_id, name, count(*) AS n FROM grams GROUP BY ALL")
cte("buckets", f"""SELECT event_id, CAST(CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT) % {DIM} AS INTEGER) AS feature, sum(1 + ln(n)) AS w
    FROM gram_counts GROUP BY ALL""")
cte("text_codes", f"""SELECT event_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w
    FROM (SELECT * FROM buckets QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(w) DESC, feature) <= {TOP})""")
Q = lambda c, n=6: f"floor(({c}) * 1e{n} + 0.5) / 1e{n}"


@shared
def text_codes(spark, d):
    return E.hash_codes(E.text_features(turns(spark, d), "event_id", "text"), "event_id", DIM, TOP)


@query("tokenize_alias", "SELECT event_id, CAST(i - 1 AS INTEGER) AS place, w[i] AS token FROM (SELECT event_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok)")
def tokenize_alias(spark, d):
    return turns(spark, d).select("event_id", F.posexplode(T.tokens(F.col("text"))).alias("place", "token"))


@query("word_ngrams", "SELECT event_id, name, count(*) AS n FROM grams WHERE name LIKE 'w2:%' GROUP BY ALL")
def word_ngrams(spark, d):
    return turns(spark, d).select("event_id", F.explode(T.word_ngrams(T.tokens(F.col("text")), 2)).alias("name")).groupBy("event_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("char_ngrams", """SELECT name, count(*) AS n FROM (SELECT 'c3:' || substr(s, i, 3) AS name
    FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT array_to_string(w, ' ') AS s FROM tok))) GROUP BY ALL""")
def char_ngrams(spark, d):
    return turns(spark, d).select(F.explode(T.char_ngrams(T.tokens(F.col("text")), 3)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("hash_encode_codes", f"SELECT event_id, feature, {Q('w')} AS w FROM text_codes")
def hash_encode_codes(spark, d):
    return text_codes(spark, d).select("event_id", "feature", quantize(F.col("w")).alias("w"))


@query("encode_diagnostics", f"""SELECT event_id, count(*) AS unique_features, count(*) - count(DISTINCT b) AS collisions, least(count(DISTINCT b), {TOP}) AS nonzero
    FROM (SELECT DISTINCT event_id, name, CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT) % {DIM} AS b FROM grams) GROUP BY event_id""")
def encode_diagnostics(spark, d):
    return E.encode_diagnostics(E.text_features(turns(spark, d), "event_id", "text"), "event_id", DIM, TOP)


# --- context ------------------------------------------------------------------------------

CONTEXT_DIM, CONTEXT_TOP = 512, 32
cte("time_names", """SELECT event_id, unnest(['time:year:' || year(ts), 'time:month:' || year(ts) || '-' || lpad(CAST(month(ts) AS VARCHAR), 2, '0'),
    'time:weekday:' || (isodow(ts) - 1), 'time:hour:' || hour(ts)]) AS name FROM events""")
cte("context_names", """SELECT * FROM time_names UNION ALL SELECT event_id, 'type:' || lower(trim(event_type)) FROM events WHERE trim(event_type) <> ''
    UNION ALL SELECT event_id, 'k:num:' || CASE WHEN k < 0 THEN 'neg' ELSE 'pos' END || ':1e' || CASE WHEN k = 0 THEN -9 ELSE CAST(floor(log10(abs(k) + 1e-9)) AS INTEGER) END
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL
    UNION ALL SELECT event_id, 'k:num_rounded:' || k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL""")
cte("context_codes_t", f"""SELECT event_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w FROM (
    SELECT event_id, CAST(CAST(('0x' || substr(md5('ctx:' || name), 1, 15)) AS BIGINT) % {CONTEXT_DIM} AS INTEGER) AS feature, sum(1 + ln(n)) AS w
    FROM (SELECT event_id, name, count(*) AS n FROM context_names GROUP BY ALL) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(sum(1 + ln(n))) DESC, feature) <= {CONTEXT_TOP})""")


def context_names(spark, d):
    ev = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    names = F.concat(E.time_features(F.col("ts")), E.string_features("type", F.col("event_type")), E.number_features("k", F.col("k")))
    return ev.select("event_id", F.explode(names).alias("name"))


def context_codes(spark, d):
    return E.hash_codes(context_names(spark, d), "event_id", CONTEXT_DIM, CONTEXT_TOP, prefix="ctx:")


@query("context_time_buckets", "SELECT * FROM time_names")
def context_time_buckets(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(E.time_features(F.col("ts"))).alias("name"))


@query("context_features", "SELECT * FROM context_names")
def context_features(spark, d):
    return context_names(spark, d)


@query("context_codes", f"SELECT event_id, feature, {Q('w')} AS w FROM context_codes_t")
def context_codes_q(spark, d):
    return context_codes(spark, d).select("event_id", "feature", quantize(F.col("w")).alias("w"))


BINDING_DIM, BOUND_TOP = 2048, 96
cte("turn_context", f"""SELECT event_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w FROM (
    SELECT event_id, CAST(CAST(('0x' || substr(md5('ctx:' || name), 1, 15)) AS BIGINT) % {CONTEXT_DIM} AS INTEGER) AS feature, sum(1 + ln(1)) AS w
    FROM (SELECT event_id, 'role:' || role AS name FROM turns UNION ALL SELECT event_id, 'turn:' || turn FROM turns) GROUP BY ALL)""")
cte("bound_parts", f"""SELECT event_id, feature, w FROM text_codes
    UNION ALL SELECT event_id, feature + {DIM}, w * 0.35 FROM turn_context
    UNION ALL SELECT h.event_id, CAST({DIM + CONTEXT_DIM} + CAST(('0x' || substr(md5(h.feature || ':' || c.feature), 1, 15)) AS BIGINT) % {BINDING_DIM} AS INTEGER), h.w * c.w * 0.45
    FROM (SELECT * FROM text_codes QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY feature) <= 64) h
    JOIN (SELECT * FROM turn_context QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY feature) <= 32) c USING (event_id)""")
cte("bound_t", f"""SELECT event_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS w FROM (
    SELECT event_id, feature, w FROM (SELECT event_id, feature, sum(w) AS w FROM bound_parts GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY floor(abs(w) * 1e9 + 0.5) DESC, feature) <= {BOUND_TOP})""")


@shared
def turn_context(spark, d):
    t = turns(spark, d)
    names = F.array(F.concat(F.lit("role:"), F.col("role")), F.concat(F.lit("turn:"), F.col("turn").cast("string")))
    return E.hash_codes(t.select("event_id", F.explode(names).alias("name")), "event_id", CONTEXT_DIM, CONTEXT_TOP, prefix="ctx:")


@query("bound_address", f"SELECT event_id, count(*) AS nonzero, {Q('sum(w)', 4)} AS total, {Q('max(w)')} AS largest FROM bound_t GROUP BY event_id")
def bound_address(spark, d):
    bound = E.bind(text_codes(spark, d), turn_context(spark, d), "event_id", DIM, CONTEXT_DIM, BINDING_DIM, BOUND_TOP)
    return bound.groupBy("event_id").agg(F.count(F.lit(1)).alias("nonzero"), quantize(F.sum("w"), 4).alias("total"), quantize(F.max("w")).alias("largest"))


# --- documents ----------------------------------------------------------------------------


@query("source_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def source_checksum(spark, d):
    return read(spark, d, "documents").select("doc_id", S.source_checksum(F.col("text")).alias("checksum"))


def _chunks(spark, d, how, size, overlap):
    return read(spark, d, "documents").select("doc_id", F.posexplode(how(F.col("text"), size, overlap)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.start", "c.end", "c.chunk")


@query("chunk_chars", """SELECT doc_id, CAST(s // 80 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start, CAST(least(s + 100, length(text)) AS INTEGER) AS end_, md5(substr(text, s + 1, 100)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 80)) AS s FROM documents)""")
def chunk_chars(spark, d):
    return _chunks(spark, d, T.char_chunks, 100, 20).select("doc_id", "chunk_index", "start", F.col("end").alias("end_"), F.md5("chunk").alias("digest"))


cte("doc_words", r"SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents")


@query("chunk_words", """SELECT doc_id, CAST(s // 40 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start, CAST(least(s + 50, len(w)) AS INTEGER) AS end_, md5(array_to_string(w[s + 1:s + 50], ' ')) AS digest
    FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 40)) AS s FROM doc_words)""")
def chunk_words(spark, d):
    return _chunks(spark, d, T.word_chunks, 50, 10).select("doc_id", "chunk_index", "start", F.col("end").alias("end_"), F.md5("chunk").alias("digest"))


@query("chunk_evidence_remap", """SELECT e.item_id, coalesce(c.doc_id || ':chunk:' || c.chunk_index, CAST(e.doc_id AS VARCHAR)) AS evidence_id
    FROM (SELECT item_id, item_id * 3 AS doc_id FROM benchmark) e
    LEFT JOIN (SELECT doc_id, s // 80 AS chunk_index FROM (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 80)) AS s FROM documents)) c USING (doc_id)""")
def chunk_evidence_remap(spark, d):
    chunks = _chunks(spark, d, T.char_chunks, 100, 20).select("doc_id", F.concat_ws(":chunk:", F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"))
    evidence = read(spark, d, "benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"))
    return SS.remap_evidence(evidence, chunks, "item_id", "doc_id", "chunk_id")


@query("sessions_to_events", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def sessions_to_events(spark, d):
    return SS.sessions_to_events(read(spark, d, "conversations"))


@query("turns_to_events", "SELECT conv_id || ':' || turn AS event_id, CAST(conv_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, role || ': ' || text AS text FROM conversations")
def turns_to_events(spark, d):
    return SS.turns_to_events(read(spark, d, "conversations"))


@query("dataset_index", "SELECT conv_id, count(*) AS n_events, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE role = 'assistant') AS n_evidence FROM conversations GROUP BY conv_id")
def dataset_index(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.length("text")).alias("n_chars"), F.count(F.when(F.col("role") == "assistant", 1)).alias("n_evidence"))


@query("continual_probes", """SELECT conv_id, turn AS step, lag, turn - least(turn, lag) AS target_step FROM (
    SELECT conv_id, turn, [0, 1, 4][turn % 3 + 1] AS lag FROM conversations)""")
def continual_probes(spark, d):
    return SS.continual_probes(read(spark, d, "conversations").select("conv_id", F.col("turn").alias("step")), (0, 1, 4))


@query("feature_export_dedup", "SELECT sha256(text) AS textsha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def feature_export_dedup(spark, d):
    return S.export_features(read(spark, d, "documents"), "doc_id")


@query("precomputed_lookup", "SELECT doc_id, f.textsha256, f.n_words FROM documents JOIN (SELECT sha256(text) AS textsha256, any_value(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS n_words FROM documents GROUP BY 1) f ON sha256(text) = f.textsha256".replace("\\\\", "\\"))
def precomputed_lookup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    features = docs.groupBy(F.sha2("text", 256).alias("textsha256")).agg(F.first(n_words).alias("n_words"))
    return S.feature_lookup(docs, features).select("doc_id", "textsha256", "n_words")


# --- store --------------------------------------------------------------------------------


@query("store_upsert_latest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def store_upsert_latest(spark, d):
    return S.upsert_latest(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("store_get", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def store_get(spark, d):
    return read(spark, d, "documents").filter("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


@query("store_delete", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def store_delete(spark, d):
    return S.delete(read(spark, d, "documents").select("doc_id", "lang", "source"), read(spark, d, "labels").filter("quality = 0"), "doc_id")


@query("posting_stats", "SELECT count(DISTINCT event_id) AS episodes, count(*) AS entries, count(DISTINCT feature) AS features FROM text_codes")
def posting_stats(spark, d):
    return S.posting_stats(text_codes(spark, d), "event_id")


cte("item_tok", f"SELECT item_id, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda t: {ALIAS_SQL}) AS w FROM benchmark")
cte("item_grams", """SELECT item_id, 'w1:' || w[i] AS name FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM item_tok)
    UNION ALL SELECT item_id, 'w2:' || w[i] || '_' || w[i + 1] FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM item_tok)""")
cte("item_codes", f"""SELECT item_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM (
    SELECT item_id, CAST(CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT) % {DIM} AS INTEGER) AS feature, sum(1 + ln(n)) AS w
    FROM (SELECT item_id, name, count(*) AS n FROM item_grams GROUP BY ALL) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY abs(sum(1 + ln(n))) DESC, feature) <= {TOP})""")
cte("votes_t", """SELECT item_id, event_id, count(*) AS votes, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, event_id) AS r
    FROM item_codes JOIN (SELECT event_id, feature FROM text_codes) USING (feature) GROUP BY 1, 2 QUALIFY r <= 100""")


@shared
def item_codes(spark, d):
    return E.hash_codes(E.text_features(read(spark, d, "benchmark"), "item_id", "text"), "item_id", DIM, TOP)


def text_votes(spark, d, limit=100):
    return S.candidate_votes(item_codes(spark, d).withColumnRenamed("item_id", "query_id"), text_codes(spark, d).withColumnRenamed("event_id", "episode_id"), limit)


@query("candidate_votes", "SELECT item_id AS query_id, event_id AS episode_id, votes, CAST(r AS INTEGER) AS rank FROM votes_t")
def candidate_votes(spark, d):
    return text_votes(spark, d)


@query("candidate_fallback", """SELECT item_id AS query_id, event_id AS episode_id FROM (SELECT b.item_id, CAST(r.r_regionkey AS BIGINT) AS event_id FROM benchmark b, region r)""")
def candidate_fallback(spark, d):
    none = text_votes(spark, d).limit(0).select("query_id", "episode_id")
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return S.with_fallback(none, queries, read(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("episode_id")), 500)


cte("retrieved_t", f"""SELECT item_id AS query_id, event_id AS episode_id, {Q('score')} AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY {Q('score', 9)} DESC, event_id) AS INTEGER) AS rank FROM (
    SELECT v.item_id, v.event_id, 0.65 * sum(q.w * t.w) + 0.3 * sum(q.w * t.w) AS score
    FROM votes_t v JOIN item_codes q ON q.item_id = v.item_id JOIN text_codes t ON t.event_id = v.event_id AND t.feature = q.feature GROUP BY 1, 2) QUALIFY rank <= 5""")


@query("retrieve_text", "SELECT query_id, episode_id, score, rank FROM retrieved_t")
def retrieve_text(spark, d):
    """Retrieval with the zero graph: the completed state is the query itself."""
    # Written, so that Spark sees how few they are and sends them to the codes.
    votes = settle(text_votes(spark, d).select("query_id", "episode_id"), "votes")
    q =item_codes(spark, d).select(F.col("item_id").alias("query_id"), "feature", F.col("w").alias("v"))
    t = text_codes(spark, d).select(F.col("event_id").alias("episode_id"), "feature", "w")
    dots = votes.join(t, "episode_id").join(q, ["query_id", "feature"]).groupBy("query_id", "episode_id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    from pyspark.sql import Window as W

    scored = dots.withColumn("score", 0.65 * F.col("dot") + 0.3 * F.col("dot"))
    order = W.partitionBy("query_id").orderBy(quantize(F.col("score"), 9).desc(), "episode_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("query_id", "episode_id", quantize(F.col("score")).alias("score"), "rank")
