"""Novelty, salience and two-signed gates, allocation, feature birth, status and corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.ranges import running_sum
from recallgrid.functions.vectors import rows_normalized

from .postings import top_votes

# Default weights of the gates.
SALIENCE = {"base": 0.5, "surprise": 0.25, "task_relevance": 0.15, "user_importance": 0.2, "novelty": 0.25, "redundancy": -0.15}
SALIENCE_RANGE = (0.05, 2.0)
POSITIVE = {
    "bias": -0.20,
    "prediction_loss": 0.40,
    "entropy": 0.20,
    "evidence_kl": 0.45,
    "novelty": 0.80,
    "redundancy": -0.45,
    "correction": 0.70,
    "useremphasis": 0.65,
    "downstreamutility": 0.75,
    "source_trust": 0.25,
    "poisonrisk": -1.25,
    "prompt_length": 0.05,
}
NEGATIVE = {"bias": -1.0, "contradiction": 1.15, "correction": 0.55, "poisonrisk": 0.85, "source_trust": -0.40, "redundancy": 0.35}
METRICS = ("prediction_loss", "entropy", "evidence_kl", "novelty", "redundancy", "contradiction", "correction", "useremphasis", "downstreamutility", "source_trust", "poisonrisk", "prompt_length", "recency")
BIRTH = {"novelty": 0.45, "interference": 0.30, "retrieval_error": 0.30, "budget_pressure": -0.40}


def novelty(codes: DataFrame, limit: int = 20, close: float = 0.45, only: DataFrame | None = None) -> DataFrame:
    """(ns, episode_id, novelty, interference) of each write against the earlier ones of its namespace.

    Earlier episodes compete by shared features (ties by id); the best dot product among
    the ``limit`` first counts. Dot products are made of these alone.
    With ``only`` (ns, episode_id, seq) these writes alone are looked up. Codes may have
    ``until``, the write that replaced theirs: later ones do not see them.
    """
    keys = ["ns", "episode_id"]
    asked = codes if only is None else codes.join(only.select(*keys, "seq"), [*keys, "seq"], "left_semi")
    until = F.col("until") if "until" in codes.columns else F.lit(None).cast("long")
    a = asked.select("ns", "feature", F.struct(*keys).alias("_q"), "seq", F.col("w").alias("_a"))
    b = codes.select("ns", "feature", F.col("episode_id").alias("_other"), F.col("seq").alias("_before"), F.col("w").alias("_b"), until.alias("_until"))
    earlier = F.expr("_before < seq AND (_until IS NULL OR seq <= _until)")
    found = top_votes(a.drop("_a"), b.drop("_b"), limit, ["ns", "feature"], "_q", "_other", ("seq", "_before", "_until"))
    pairs = found.select("_q", "_q.ns", "_other").join(a.select("_q", "feature", "seq", "_a"), "_q").join(b, ["ns", "_other", "feature"]).filter(earlier)
    top = pairs.groupBy("_q", "_other").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot")).select("_q.ns", "_q.episode_id", "_dot")
    best = top.groupBy("ns", "episode_id").agg(F.max("_dot").alias("_m"), F.sum(F.when(F.col("_dot") > close, 1).otherwise(0)).alias("_n"))
    every = asked.select("ns", "episode_id").distinct().join(best, ["ns", "episode_id"], "left")
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_m")))
    return every.select("ns", "episode_id", F.coalesce(clamp, F.lit(1.0)).alias("novelty"), F.least(F.lit(1.0), F.coalesce("_n", F.lit(0)) / 5.0).alias("interference"))


def salience(signals: dict[str, Column], weights: dict[str, float] = SALIENCE, bounds: tuple[float, float] = SALIENCE_RANGE) -> Column:
    value = F.lit(weights["base"])
    for name, w in weights.items():
        if name != "base":
            value = value + w * F.coalesce(signals.get(name, F.lit(None)).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value))


def number(*names: Column, default: Column | float = 0.0) -> Column:
    """The first of several text or number columns that reads as a finite number."""
    tried = [F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x) for x in (n.try_cast("double") for n in names)]
    return F.coalesce(*tried, F.lit(default) if isinstance(default, float) else default)


def flag(*names: Column, as_documented: bool) -> Column:
    """As the semantics are written, flags always count 0; as documented, 1 if any is set."""
    if not as_documented:
        return F.lit(0.0)
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(n.try_cast("boolean"), F.lit(False))
    return out.cast("double")


def metadata(meta: Column) -> Column:
    """A JSON object's top-level values as texts, parsed once for all that ask for them."""
    return F.from_json(meta, "map<string,string>")


def dopamine_metrics(meta: Column, text_length: Column, new: Column, known: Column, as_documented: bool = False, parsed: bool = False) -> dict[str, Column]:
    """The thirteen gate inputs from a JSON text column, or with ``parsed`` from a column of ``metadata``.

    The alias lists below are fixed values, tried in order.
    """
    g = (lambda name: F.try_element_at(meta, F.lit(name))) if parsed else (lambda name: F.get_json_object(meta, f"$.{name}"))
    nums = lambda *names, default=0.0: number(*[g(n) for n in names], default=default)
    flags = lambda *names: flag(*[g(n) for n in names], as_documented=as_documented)
    length = nums("prompt_length", "tokens", "length")
    length = F.when(length != 0, length).otherwise(text_length.cast("double"))
    return {
        "prediction_loss": nums("prediction_loss", "loss", "loss_spike"),
        "entropy": nums("entropy", "predictive_entropy"),
        "evidence_kl": nums("evidence_kl", "kl", "evidence_impact"),
        "novelty": nums("novelty", default=new),
        "redundancy": nums("redundancy", default=known),
        "contradiction": nums("contradiction", "conflict") + flags("contradicts"),
        "correction": nums("correction", "user_correction") + flags("corrects", "supersedes"),
        "useremphasis": nums("useremphasis", "user_importance", "remember"),
        "downstreamutility": nums("utility", "downstreamutility", "reward"),
        "source_trust": nums("source_trust", "trust", default=1.0),
        "poisonrisk": F.greatest(nums("poisonrisk", "risk"), flags("generated", "self_generated", "hypothetical") * 0.65, flags("untrusted", "prompt_injection", "poison")),
        "prompt_length": F.log1p(F.greatest(F.lit(0.0), length)) / 10.0,
        "recency": nums("recency"),
    }


def raw_gate(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum that a gate squashes."""
    raw = F.lit(weights["bias"])
    for name in METRICS:
        if name in weights:
            raw = raw + weights[name] * metrics[name]
    return raw


def gate(metrics: dict[str, Column], weights: dict[str, float], minimum: float, maximum: float = 2.0) -> Column:
    return F.greatest(F.lit(minimum), F.least(F.lit(maximum), maximum / (1 + F.exp(-raw_gate(metrics, weights)))))


def gate_pair(metrics: dict[str, Column]) -> tuple[Column, Column]:
    return gate(metrics, POSITIVE, 0.02), gate(metrics, NEGATIVE, 0.0)


def decay_rate(negative: Column) -> Column:
    """Decay that a strong negative signal triggers; 0 otherwise."""
    return F.when(negative > 0.5, F.least(F.lit(0.05), 0.01 * negative)).otherwise(0.0)


def allocation_gain(codes: DataFrame, novelty: Column | float = 0.0, utility: Column | float = 0.0, rate: float = 0.95, degrees: DataFrame | None = None, hub: float = 0.5) -> DataFrame:
    """Adds eligibility and gain; a feature's writes are folded as a sorted stream.

    Eligibility decays at every write of the namespace and vanishes under 1e-6. With
    ``degrees`` (ns, feature, degree) gains are divided by (1 + degree) ** hub.
    """
    numbered = codes.withColumn("t", F.dense_rank().over(W.partitionBy("ns").orderBy("seq")).cast("long"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, e, last = None, 0.0, 0
        for p in parts:
            out = np.empty(len(p))
            for k, (ns, feature, t, w) in enumerate(zip(p["ns"], p["feature"], p["t"], p["w"], strict=True)):
                if (ns, feature) != key:
                    key, e, last = (ns, feature), 0.0, t
                for _ in range(t - last):
                    e *= rate
                    if e < 1e-6:
                        e = 0.0
                        break
                e, last = e + abs(w), t
                out[k] = e
            yield p.assign(eligibility=out)

    folded = numbered.repartition("ns", "feature").sortWithinPartitions("ns", "feature", "t").mapInPandas(run, numbered.schema.add("eligibility", "double"))
    raw = 1.0 + 0.30 * F.lit(novelty) + 0.20 * F.lit(utility) + 0.05 * F.log1p("eligibility")
    if degrees is not None:
        folded = folded.join(degrees, ["ns", "feature"], "left")
        raw = raw / F.pow(1.0 + F.coalesce("degree", F.lit(0.0)), F.lit(hub))
    gained = folded.withColumn("gain", F.greatest(F.lit(0.15), F.least(F.lit(2.0), raw)))
    return gained.drop("degree")


def allocated(gains: DataFrame) -> DataFrame:
    """(ns, episode_id, feature, w): the addresses of ``allocation_gain`` times their gains, unit length."""
    return rows_normalized(gains.select("ns", "episode_id", "feature", (F.col("w") * F.col("gain")).alias("w")), ["ns", "episode_id"])


def augmented(codes: DataFrame, born: DataFrame, reserved: int, authority: float = 0.10) -> DataFrame:
    """(ns, episode_id, feature, w): codes whose episodes are in ``born`` (ns, episode_id, slot) gain the feature ``reserved`` + slot.

    Its weight is ``authority`` times the code's largest value; the code is normalised again, others stay as they are.
    """
    keys = ["ns", "episode_id"]
    marked = codes.select(*keys, "feature", "w").join(born.select(*keys, "slot"), keys)
    new = marked.groupBy(*keys, "slot").agg((F.max("w") * authority).alias("w")).select(*keys, (F.col("slot") + reserved).cast("int").alias("feature"), "w")
    grown = rows_normalized(marked.select(*keys, "feature", "w").unionByName(new), keys)
    return codes.select(*keys, "feature", "w").join(born.select(*keys), keys, "left_anti").unionByName(grown)


def birth_score(new: Column, interference: Column, retrieval_error: Column, budget_pressure: Column) -> Column:
    raw = BIRTH["novelty"] * new + BIRTH["interference"] * interference + BIRTH["retrieval_error"] * retrieval_error + BIRTH["budget_pressure"] * budget_pressure
    return 1.0 / (1.0 + F.exp(-4.0 * (raw - 0.5)))


def births(scored: DataFrame, slots: int, threshold: float = 0.75) -> DataFrame:
    """Adds slot (from 0) to writes whose birth_score reaches the threshold, while slots last."""
    born = scored.filter(F.col("birth_score") >= threshold)
    return born.withColumn("slot", F.row_number().over(W.partitionBy("ns").orderBy("seq")) - 1).filter(F.col("slot") < slots)


def maturation(hits: DataFrame, needed: int = 3, authority: float = 0.10) -> DataFrame:
    """(feature_id, verified_hits, false_hits, maturity, authority, status) after ordered hits (feature_id, seq, helpful).

    A stream sorted by feature and seq is folded; authority stays within 0 and 1.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["feature_id", "verified_hits", "false_hits", "maturity", "authority", "status"]
        now = None
        for p in parts:
            done = []
            for feature, helpful in zip(p["feature_id"], p["helpful"], strict=True):
                if now is None or now[0] != feature:
                    done += [now] if now else []
                    now = [feature, 0, 0, 0.0, authority, "immature"]
                if helpful:
                    now[1] += 1
                    now[3], now[4] = min(1.0, now[3] + 1.0 / max(1, needed)), min(1.0, now[4] + 0.25)
                else:
                    now[2] += 1
                    now[4] = max(0.0, now[4] - 0.25)
                if now[1] >= needed:
                    now[5] = "mature"
                if now[2] > now[1] + 2:
                    now[4], now[5] = 0.0, "pruned"
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame([now] if now else [], columns=columns)

    kind = hits.schema["feature_id"].dataType.simpleString()
    ordered = hits.select("feature_id", "seq", "helpful").repartition("feature_id").sortWithinPartitions("feature_id", "seq")
    return ordered.mapInPandas(run, f"feature_id {kind}, verified_hits long, false_hits long, maturity double, authority double, status string")


def status(meta: Column) -> Column:
    on = lambda name: F.coalesce(F.get_json_object(meta, f"$.{name}").try_cast("boolean"), F.lit(False))
    return F.when(on("rejected"), "rejected").when(on("hypothetical") | on("generated"), "hypothetical").otherwise("observed")


def latent_authority(state: Column, risk: Column) -> Column:
    return F.when(state == "hypothetical", 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - risk))


def checksum_for(text: Column, given: Column, generated: Column) -> Column:
    """A given checksum stays; observed events without one get the digest of their text."""
    return F.coalesce(given, F.when(~generated, F.sha2(text, 256)))


def corrected(episodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Episodes after corrections (old_id, new_id): superseded, confidence at most 0.25, authority down by 0.35 each time."""
    hits = corrections.groupBy(F.col("old_id").alias("episode_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("new_id").alias("superseded_by"))
    joined = episodes.join(hits, "episode_id", "left")
    hit = F.col("_n").isNotNull()
    return (
        joined.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))
        .withColumn("confidence", F.when(hit, F.least("confidence", F.lit(0.25))).otherwise(F.col("confidence")))
        .withColumn("authority", F.when(hit, F.greatest(F.lit(0.0), F.col("authority") - 0.35 * F.col("_n"))).otherwise(F.col("authority")))
        .drop("_n")
    )


def prospective_prompts(rows: DataFrame, query: str, entity: str, most: int = 8) -> DataFrame:
    """(all columns, place, prompt): templates for likely future questions; they never become episodes."""
    q, e = F.col(query), F.col(entity)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    none = F.array().cast("array<string>")
    asked = F.when(has(q), F.array(F.concat(F.lit("Follow-up: "), q), F.concat(F.lit("What evidence would verify the answer to: "), q))).otherwise(none)
    about = F.when(has(e), F.array(F.concat(F.lit("What changed most recently about "), e, F.lit("?")), F.concat(F.lit("Which previous memory conflicts with "), e, F.lit("?")))).otherwise(none)
    last = F.array(F.lit("Which future task is likely to need the most salient recent engram?"))
    return rows.select("*", F.posexplode(F.slice(F.concat(asked, about, last), 1, most)).alias("place", "prompt"))


def simulated(prompts: DataFrame, keys: list[str], authority: float = 0.10) -> DataFrame:
    """Traces of likely questions (keys..., place, prompt): numbered in order of keys and place, without factual authority.

    They can be retrieved with little authority and are never facts.
    """
    first = running_sum(prompts.withColumn("_one", F.lit(1).cast("long")), [], [*[F.col(k) for k in keys], F.col("place")], "_one")
    traces = first.withColumn("trace_id", F.concat(F.lit("prospective:"), F.col("_before").cast("string"))).withColumnRenamed("_before", "created")
    return traces.drop("_one", "_total").withColumns({"factual_authority": F.lit(0.0), "retrieval_authority": F.lit(authority), "promoted": F.lit(False)})


def promoted(traces: DataFrame, questions: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Traces after the questions (prompt) that came: each promotes the first trace of its words that is not promoted yet.

    So of the traces with a prompt as many are promoted, in order of creation, as it was
    asked; factual authority stays 0. A threshold above 1 matches nothing.
    """
    asked = questions.groupBy("prompt").agg(F.count(F.lit(1)).alias("_asked"))
    open_ones = running_sum(traces.withColumn("_open", (~F.col("promoted")).cast("long")), ["prompt"], [F.col("created")], "_open")
    hit = ~F.col("promoted") & (F.col("_before") < F.coalesce("_asked", F.lit(0))) & F.lit(threshold <= 1.0)
    return open_ones.join(asked, "prompt", "left").withColumn("promoted", F.col("promoted") | hit).drop("_open", "_before", "_total", "_asked").withColumn("factual_authority", F.lit(0.0))
