"""Evaluation pass and score backfill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.markdown import PRE_SCORE
from ..operators import evaluation as E, similarity
from ..operators.evaluation import Limits
from ..session import cut_lineage


#: Large columns of a prepared request, which no decision reads.
TEXTS = ["text", "scrubbed", "request_text", "prompt"]


def decisions(postings: DataFrame, cache: DataFrame, cost_log: DataFrame, today: dt.date, digests: dict[str, str],
              template: str, profiles_hash: str, model: str, prompt_version: str, limits: Limits = Limits()) -> DataFrame:
    """What becomes of each pending posting, with all facts of its request but the texts.

    ``action`` is ``send``, ``cached`` or a stop reason.  Only postings in state ``scraped`` are taken; free checks
    run before the budget.  The text rules run once: the facts are written, and the budget reads them several times.
    """
    pending = postings.where(F.col("state") == "scraped").select("project_id", "text")
    facts = cut_lineage(E.prepare(pending, digests, template, profiles_hash, model, prompt_version, limits).drop(*TEXTS))
    looked_up = E.cache_lookup(facts, cache)
    open_ = looked_up.where(F.col("evaluation_status").isNull() & ~F.col("cache_hit"))
    admitted = E.admit(open_.select("project_id", "est_cost"), cost_log, today, ["project_id"], limits) \
        .select("project_id", "budget_reason", F.lit(True).alias("_asked"))
    df = looked_up.join(admitted, "project_id", "left")
    action = F.when(F.col("evaluation_status").isNotNull(), F.col("evaluation_status")) \
        .when(F.col("cache_hit"), "cached").when(F.col("budget_reason").isNotNull(), "pending_retry").otherwise("send")
    return df.withColumn("action", action).drop("_asked")


def requests_for(postings: DataFrame, cache: DataFrame, cost_log: DataFrame, today: dt.date, digests: dict[str, str],
                 template: str, profiles_hash: str, model: str, prompt_version: str,
                 limits: Limits = Limits()) -> DataFrame:
    """The :func:`decisions` with the texts of their requests, which are made once more for that."""
    rules = (digests, template, profiles_hash, model, prompt_version, limits)
    pending = postings.where(F.col("state") == "scraped").select("project_id", "text")
    texts = E.prepare(pending, *rules).select("project_id", *TEXTS)
    return decisions(postings, cache, cost_log, today, *rules).join(texts, "project_id")


def state_events(results: DataFrame, now: dt.datetime) -> DataFrame:
    """Only a successful evaluation changes the state."""
    return results.where("evaluation_status = 'ok'").select(
        "project_id", F.lit("evaluated").alias("to_state"), F.lit(now).alias("ts"),
        F.concat(F.lit("LLM-Bewertung: best_profile="), "best_profile", F.lit(" score="),
                 F.col("best_score").cast("string")).alias("note"), F.lit(False).alias("force"))


def backfill(bodies: DataFrame, profiles: DataFrame, key: str, body: str = "body", min_score: float = 0.0) -> DataFrame:
    """Score rows for bodies without a score; ``outcome`` tells what became of each row."""
    has_score = F.col(body).rlike(PRE_SCORE)
    open_ = bodies.where(~has_score).select(key, F.col(body).alias("text"))
    scored = similarity.best_profiles(open_, profiles, key, top_n=0).select(
        key, "best_profile", F.bround(F.col("best_score") * 100).cast("int").alias("score"),
        F.when(F.col("best_score") >= min_score, "scored").otherwise("skipped_low").alias("outcome"))
    done = bodies.where(has_score).select(
        key, F.lit(None).cast("string").alias("best_profile"), F.lit(None).cast("int").alias("score"),
        F.lit("skipped_existing").alias("outcome"))
    return scored.unionByName(done)
