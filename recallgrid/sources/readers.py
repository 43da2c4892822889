"""Benchmark files as (example_id, task, query, answers, evidence_ids, negative_ids, events) rows.

Events are an array of (event_id, text, timestamp, metadata JSON). Everything is native:
JSON is read by Spark and reshaped by expressions; nothing is fetched from a network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.text import char_chunks, word_chunks

EVENT = "struct<event_id:string,text:string,timestamp:string,metadata:string>"
EXAMPLE = f"example_id string, task string, query string, answers array<string>, evidence_ids array<string>, negative_ids array<string>, events array<{EVENT}>"


def _event(event_id: Column, text: Column, timestamp: Column | None = None, metadata: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    fields = {"event_id": event_id, "text": text, "timestamp": none if timestamp is None else timestamp, "metadata": none if metadata is None else metadata}
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _rows(df: DataFrame, example_id: Column, task: Column, query: Column, answers: Column, evidence: Column, events: Column, negatives: Column | None = None) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(example_id.alias("example_id"), task.alias("task"), query.alias("query"), F.coalesce(answers, empty).alias("answers"), F.coalesce(evidence, empty).alias("evidence_ids"), (negatives if negatives is not None else empty).alias("negative_ids"), events.alias("events"))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Typed JSON or JSON lines; a file that does not fit fails when it is read."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def session_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions with parallel arrays of sessions; a session becomes one event, its turns lines of ``role: content``."""
    schema = "question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
    df = read_json(spark, path, schema)
    own = lambda s: F.concat_ws(":", F.col("question_id"), s)
    lines = lambda s: F.array_join(F.transform(s, lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n")
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("i"), F.col("haystack_dates").alias("d"), F.col("haystack_sessions").alias("s"))
    events = F.transform(zipped, lambda x: _event(own(x["i"]), lines(x["s"]), x["d"]))
    return _rows(df, F.col("question_id"), F.coalesce("question_type", F.lit("session_qa")), F.col("question"), F.array("answer"), F.transform("answer_session_ids", own), events)


def flexible_qa(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Rows whose fields go by several names; the first one present counts."""
    names = {"id": ("id", "question_id", "example_id"), "query": ("question", "query", "prompt"), "answer": ("answer", "answers", "target"), "context": ("context", "history", "trajectory"), "evidence": ("evidence_ids", "evidence", "answer_session_ids")}
    schema = ", ".join(f"{n} string" for group in names.values() for n in group)
    df = read_json(spark, path, schema, lines)
    first = {k: F.coalesce(*[F.col(n) for n in group]) for k, group in names.items()}
    as_list = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.when(c.isNotNull(), F.array(c)))
    parts = F.coalesce(as_list(first["context"]), F.array().cast("array<string>"))
    events = F.transform(parts, lambda t, i: _event(F.concat_ws(":", first["id"], i.cast("string")), t))
    return _rows(df, first["id"], F.lit("flexible_qa"), first["query"], as_list(first["answer"]), as_list(first["evidence"]), events)


def dialogue_qa(spark: SparkSession, path: str) -> DataFrame:
    """Dialogues with ``session_N`` keys; each turn is an event, sessions in order of N, evidence by dialogue id."""
    schema = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
    df = read_json(spark, path, schema)
    numbered = F.filter(F.map_keys("conversation"), lambda k: k.rlike(r"^session_\d+$"))
    order = F.array_sort(F.transform(numbered, lambda k: F.named_struct(F.lit("n"), F.regexp_extract(k, r"(\d+)$", 1).cast("int"), F.lit("k"), k)))
    turn = "array<struct<speaker:string,dia_id:string,text:string>>"
    event_id = lambda d: F.concat_ws(":", F.col("sample_id"), d)
    per_session = F.transform(order, lambda x: F.transform(F.from_json(F.col("conversation")[x["k"]], turn), lambda t: _event(event_id(t["dia_id"]), F.concat_ws(": ", t["speaker"], t["text"]), F.try_element_at("conversation", F.concat(x["k"], F.lit("_date_time"))))))
    flat = df.select("sample_id", F.flatten(per_session).alias("events"), F.posexplode("qa").alias("n", "q"))
    task = F.concat(F.lit("category_"), F.col("q.category").cast("string"))
    return _rows(flat, F.concat_ws(":qa:", F.col("sample_id"), F.col("n")), task, F.col("q.question"), F.array("q.answer"), F.transform("q.evidence", event_id), F.col("events"))


def long_context(spark: SparkSession, path: str, lines: bool = True, task: str = "long_context") -> DataFrame:
    """One event per row: its context."""
    df = read_json(spark, path, "_id string, input string, context string, answers array<string>, dataset string", lines)
    return _rows(df, F.col("_id"), F.coalesce("dataset", F.lit(task)), F.col("input"), F.col("answers"), F.array(F.concat(F.col("_id"), F.lit(":context"))), F.array(_event(F.concat(F.col("_id"), F.lit(":context")), F.col("context"))))


def multiple_choice(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Four choices are put onto the query as lines A to D."""
    df = read_json(spark, path, "_id string, domain string, question string, choice_A string, choice_B string, choice_C string, choice_D string, answer string, context string", lines)
    query = F.concat_ws("\n", "question", *[F.concat(F.lit(f"{x}. "), F.col(f"choice_{x}")) for x in "ABCD"])
    return _rows(df, F.col("_id"), F.coalesce("domain", F.lit("multiple_choice")), query, F.array("answer"), F.array(F.concat(F.col("_id"), F.lit(":context"))), F.array(_event(F.concat(F.col("_id"), F.lit(":context")), F.col("context"))))


def prompts(spark: SparkSession, path: str, lines: bool = True, query: str = "Answer the question in the context.") -> DataFrame:
    """The prompt is one event; rows without a query get a default one."""
    df = read_json(spark, path, "index string, input string, query string, outputs array<string>, task string", lines)
    name = F.concat_ws(":", F.coalesce("task", F.lit("prompts")), "index")
    return _rows(df, name, F.coalesce("task", F.lit("prompts")), F.coalesce("query", F.lit(query)), F.col("outputs"), F.array(F.concat(name, F.lit(":prompt"))), F.array(_event(F.concat(name, F.lit(":prompt")), F.col("input"))))


def chunked(examples: DataFrame, size: int, overlap: int, unit: str = "characters", tokenizer: str | None = None) -> DataFrame:
    """Events cut into chunks ``id:chunk:n``; evidence and negatives stand for all chunks of their events.

    ``unit`` is characters, words or tokens; tokens need the file of a ``tokenizer``. A
    chunk's metadata are the event's with parent_event_id, chunk_index, chunk_start and
    chunk_end, counted in units, and chunk_unit.
    """
    unit = {"character": "characters", "word": "words", "token": "tokens"}.get(unit, unit)
    if unit not in ("characters", "words", "tokens"):
        raise ValueError(f"unknown unit {unit}")
    if unit == "tokens":
        cut = examples.withColumn("_s", token_chunks(F.transform("events", lambda e: e["text"]), tokenizer, size, overlap))
    else:
        how = char_chunks if unit == "characters" else word_chunks
        cut = examples.withColumn("_s", F.transform("events", lambda e: how(e["text"], size, overlap)))

    def chunk(e: Column, c: Column, n: Column) -> Column:
        own = F.coalesce(F.from_json(e["metadata"], "map<string,string>"), F.create_map().cast("map<string,string>"))
        place = {"parent_event_id": e["event_id"], "chunk_index": n, "chunk_start": c["start"], "chunk_end": c["end"], "chunk_unit": F.lit(unit)}
        added = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), v.cast("string"))])
        kept = F.map_filter(own, lambda k, _: ~k.isin(*place))
        return F.struct(F.concat_ws(":chunk:", e["event_id"], n.cast("string")).alias("event_id"), c["chunk"].alias("text"), e["timestamp"].alias("timestamp"), F.to_json(F.map_concat(kept, added)).alias("metadata"), e["event_id"].alias("of"))

    parts = F.flatten(F.transform(F.arrays_zip(F.col("events").alias("e"), F.col("_s").alias("s")), lambda z: F.transform(z["s"], lambda c, n: chunk(z["e"], c, n))))
    cut = cut.withColumn("_c", parts)
    children = lambda ids: F.flatten(F.transform(ids, lambda i: _or_self(F.transform(F.filter("_c", lambda c: c["of"] == i), lambda c: c["event_id"]), i)))
    return cut.select("example_id", "task", "query", "answers", children(F.col("evidence_ids")).alias("evidence_ids"), children(F.col("negative_ids")).alias("negative_ids"), F.transform("_c", lambda c: _event(c["event_id"], c["text"], c["timestamp"], c["metadata"])).alias("events"))


def token_coder(path: str | None) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
    """(encode, decode) without special tokens of a vocabulary file: .json of tokenizers, .model of sentencepiece."""
    if path is None:
        raise ValueError("token chunks need a tokenizer")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.no_truncation()
        return lambda t: coder.encode(t, add_special_tokens=False).ids, coder.decode
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return model.encode, model.decode
    raise ValueError(f"unknown tokenizer: {path}")


def token_chunks(texts: Column, path: str | None, size: int, overlap: int) -> Column:
    """For an array of texts, the array of each one's (start, end, chunk) over tokens, decoded; Arrow batches, the tokenizer read once a worker."""
    token_coder(path)  # an unknown one fails here, not in a task
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    coders: dict = {}

    def cut(batch: list[str] | None) -> list[list[dict]]:
        if not coders:
            coders["encode"], coders["decode"] = token_coder(path)
        out = []
        for text in [] if batch is None else batch:
            ids = coders["encode"](text or "")
            starts = range(0, max(1, len(ids)), size - overlap)
            out.append([{"start": s, "end": min(len(ids), s + size), "chunk": coders["decode"](ids[s : s + size]) if ids else ""} for s in starts])
        return out

    return F.udf(cut, "array<array<struct<start:int,end:int,chunk:string>>>", useArrow=True)(texts)


def _or_self(found: Column, one: Column) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(one))


def example_index(examples: DataFrame) -> DataFrame:
    """(example_id, task, n_events, query_chars, n_evidence)."""
    return examples.select("example_id", "task", F.size("events").alias("n_events"), F.length("query").alias("query_chars"), F.size("evidence_ids").alias("n_evidence"))
