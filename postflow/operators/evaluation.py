"""Preparing and ingesting external evaluations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import pii, responses, text as X, urls
from . import admission
from .ordered import running_sum


@dataclass(frozen=True)
class Limits:
    max_input_tokens: int = 6000
    max_output_tokens: int = 1024
    max_cost_per_call: float = 0.05
    daily_budget: float = 2.0
    monthly_budget: float = 20.0
    max_calls_per_run: int | None = 50  # None: the budgets alone decide
    high_threshold: int = responses.HIGH_THRESHOLD
    low_threshold: int = responses.LOW_THRESHOLD

    @property
    def text_budget(self) -> int:
        return (self.max_input_tokens - X.PROMPT_OVERHEAD_TOKENS) * X.CHARS_PER_TOKEN


def latest_cache(cache: DataFrame, order: str = "line") -> DataFrame:
    """The last written row per key; a plain aggregate, so a hot key is reduced map-side."""
    values = [c for c in cache.columns if c != "cache_key"]
    return cache.where(F.coalesce("cache_key", F.lit("")) != "").groupBy("cache_key").agg(
        F.max_by(F.struct(*values), F.col(order)).alias("v")).select("cache_key", "v.*")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds the cached result columns and ``cache_hit``; the request keeps its own id."""
    cached = latest_cache(cache).withColumn("_hit", F.lit(True)).drop("project_id", "cache_hit")
    return requests.join(cached, "cache_key", "left") \
        .withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def prepare(postings: DataFrame, digests: dict[str, str], template: str, profiles_hash: str,
            model: str, prompt_version: str, limits: Limits = Limits()) -> DataFrame:
    """C4 up to the request: scrub, gate, truncate, key, prompt and estimates."""
    df = pii.scrub(postings, "text")
    short, truncated = X.truncate_middle(F.col("scrubbed"), limits.text_budget)
    df = df.withColumns({"request_text": short, "input_truncated": truncated,
                         "pii_replacements": pii.total_replacements()})
    too_short = F.col("input_truncated") & (F.length("request_text") < X.SHORT_BUDGET)
    df = df.withColumn("evaluation_status", F.when(~F.col("safe") | too_short, "unsafe_content"))
    df = df.withColumn("cache_key", urls.cache_key(
        F.col("request_text"), F.lit(profiles_hash), F.lit(prompt_version), F.lit(model),
        F.lit(limits.high_threshold), F.lit(limits.low_threshold)))
    df = df.withColumn("prompt", responses.prompt(
        template, F.col("request_text"), digests, F.col("input_truncated")))
    df = df.withColumn("est_input_tokens", X.estimate_tokens(F.col("prompt")))
    return df.withColumn("est_cost", X.estimate_cost(
        F.col("est_input_tokens"), F.lit(limits.max_output_tokens)).cast("decimal(18,6)"))


def spent(cost_log: DataFrame, today: dt.date) -> DataFrame:
    """A5: one row (daily_usd, monthly_usd); reservations count as spent."""
    day, month = today.isoformat(), today.isoformat()[:7]
    is_text = dict(cost_log.dtypes)["timestamp"] == "string"
    ts, cost = F.col("timestamp") if is_text else F.col("timestamp").cast("string"), F.col("cost_usd")
    zero = F.lit(0).cast("decimal(18,6)")
    # Only the month is read: a prefix test on a text column reaches the scan.
    return cost_log.where(ts.startswith(month)).agg(
        F.coalesce(F.sum(F.when(ts.startswith(day), cost)), zero).alias("daily_usd"),
        F.coalesce(F.sum(F.when(ts.startswith(month), cost)), zero).alias("monthly_usd"))


def cost_statistics(cost_log: DataFrame, today: dt.date) -> DataFrame:
    """A4: actual entries only, one pass."""
    day, month = today.isoformat(), today.isoformat()[:7]
    ts, cost = F.col("timestamp").cast("string"), F.col("cost_usd")
    zero = F.lit(0).cast("decimal(18,6)")
    return cost_log.where(F.col("type") == "actual").agg(
        F.coalesce(F.sum(F.when(ts.startswith(day), cost)), zero).alias("cost_today_usd"),
        F.coalesce(F.sum(F.when(ts.startswith(month), cost)), zero).alias("cost_month_usd"),
        F.count("*").alias("calls_total"),
        F.count_if(ts.startswith(day)).alias("calls_today"),
        F.count_if(F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"),
        F.max(ts).alias("last_updated"))


def admit(requests: DataFrame, cost_log: DataFrame, today: dt.date, order: list[str],
          limits: Limits = Limits()) -> DataFrame:
    """W10 for one run: adds ``budget_reason``, null where a call is admitted.

    Calls are admitted in order while day and month budgets last.  A run with a call
    limit can admit no more candidates than that: a distributed top-n finds them and the
    running sum covers just these rows.  Without one the running sum covers all.
    """
    used = spent(cost_log, today).first()  # one row of two numbers
    left = min(limits.daily_budget - float(used["daily_usd"]), limits.monthly_budget - float(used["monthly_usd"]))
    too_dear = F.col("est_cost") > limits.max_cost_per_call
    candidates = requests.where(~too_dear).select(*order, "est_cost")
    if limits.max_calls_per_run is None:
        summed = running_sum(candidates, [], order, F.col("est_cost"), "_sum")
    else:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        summed = candidates.orderBy(*order).limit(limits.max_calls_per_run).withColumn("_sum", F.sum("est_cost").over(w))
    admitted = summed.where(F.col("_sum") <= left).select(*order, F.lit(True).alias("_admitted"))
    reason = F.when(too_dear, "cost per call") \
        .when(F.col("_admitted").isNull(), "run, day or month limit")
    return requests.join(admitted, order, "left").withColumn("budget_reason", reason).drop("_admitted")


def admit_greedy(requests: DataFrame, cost_log: DataFrame, today: dt.date, order: list[str],
                 limits: Limits = Limits()) -> DataFrame:
    """W10 for one run, as :func:`admit`, but a call that does not fit leaves room for later, cheaper ones.

    Admission up to the last allowed call does not depend on the call limit, so the limit takes the first
    admitted calls.  What is left of the budgets stays a column: nothing of the log comes to the driver.
    """
    daily, monthly = F.lit(str(limits.daily_budget)), F.lit(str(limits.monthly_budget))
    left = spent(cost_log, today).select(F.lit(0).alias("_run"), F.least(
        daily.cast(admission.MONEY) - F.col("daily_usd"), monthly.cast(admission.MONEY) - F.col("monthly_usd")).alias("budget"))
    too_dear = F.col("est_cost") > limits.max_cost_per_call
    calls = requests.where(~too_dear).select(F.lit(0).alias("_run"), *order, "est_cost")
    won = admission.greedy(calls, left, ["_run"], order, F.col("est_cost")).where("admitted").select(*order, "admitted")
    if limits.max_calls_per_run is not None:
        won = won.orderBy(*order).limit(limits.max_calls_per_run)
    reason = F.when(too_dear, "cost per call").when(F.col("admitted").isNull(), "run, day or month limit")
    return requests.join(won, order, "left").withColumn("budget_reason", reason).drop("admitted")


def eligible(postings: DataFrame, score: Column, minimum: int, already: Column | None = None) -> DataFrame:
    """postings that reach the minimum score and, where ``already`` is given, have not been scored.

    A missing score counts as 0, a missing ``already`` as not scored.
    """
    enough = F.coalesce(score, F.lit(0)) >= minimum
    return postings.where(enough if already is None else enough & ~F.coalesce(already, F.lit(False)))


def admit_log(entries: DataFrame, period: list[str], order: list[str], cost: Column,
              budget: float) -> DataFrame:
    """W10 over a whole log: running total per period and whether it is within budget.

    Prefix semantics: once a period is over budget nothing later in it is admitted.
    """
    return running_sum(entries, period, order, cost, "running_usd") \
        .withColumn("admitted", F.col("running_usd") <= budget)


def reservations(requests: DataFrame, now: dt.datetime) -> DataFrame:
    """Reservation rows of admitted requests; the id is derived, so a retry repeats it."""
    return requests.where("budget_reason is null").select(
        F.lit("reserved").alias("type"),
        F.sha2(F.concat_ws("|", F.col("cache_key"), F.col("project_id"), F.lit(now.isoformat())), 256)
        .alias("reservation_id"),
        F.lit(now.isoformat()).alias("timestamp"), "project_id",
        F.col("est_cost").alias("cost_usd"))


def settle(cost_log: DataFrame, actual: DataFrame) -> DataFrame:
    """An actual entry replaces the reservation with its id, else it is appended."""
    ids = actual.where(F.coalesce("reservation_id", F.lit("")) != "").select("reservation_id").distinct() \
        .withColumn("_settled", F.lit(True))
    kept = cost_log.join(ids, "reservation_id", "left") \
        .where(~((F.col("type") == "reserved") & F.coalesce("_settled", F.lit(False)))).drop("_settled")
    return kept.select(*cost_log.columns).unionByName(actual, allowMissingColumns=True)


def ingest(answers: DataFrame, profile_ids: list[str], limits: Limits = Limits()) -> DataFrame:
    """Validated evaluations, best profile, actual cost, label and status.

    ``answers`` holds ``raw`` (null for a failed call), ``error``, and the token counts.
    """
    df = answers.withColumn("_v", responses.validate_response(F.col("raw"), profile_ids))
    # The highest score, the first profile on a tie.
    ranked = F.transform("_v.evaluations", lambda e, i: F.struct(
        e["score"].alias("score"), (-i).alias("i"), e["profile_id"].alias("profile_id")))
    best = F.array_max(ranked)
    failed_call = F.col("raw").isNull()
    ok = ~failed_call & F.col("_v.error").isNull()
    return df.withColumns({
        "evaluations": F.col("_v.evaluations"),
        "best_profile": F.when(ok, best["profile_id"]).otherwise(""),
        "best_score": F.when(ok, best["score"]).otherwise(0),
        "cost_usd": F.when(ok, X.estimate_cost(F.col("input_tokens"), F.col("output_tokens")))
        .otherwise(0.0).cast("decimal(18,6)"),
        "evaluation_status": F.when(failed_call, "pending_retry").when(ok, "ok").otherwise("failed"),
        "error_detail": F.when(failed_call, F.col("error")).otherwise(F.coalesce("_v.error", F.lit(""))),
    }).withColumn("llm_priority", responses.priority_label(
        F.col("best_score"), limits.high_threshold, limits.low_threshold)).drop("_v")


def pass_statistics(results: DataFrame) -> DataFrame:
    """Counts by outcome, split on the message where the status is shared."""
    status, budget = F.col("evaluation_status"), F.col("error_detail").contains("Budget")
    return results.agg(
        F.count("*").alias("projects_found"),
        F.count_if(status == "ok").alias("projects_ok"),
        F.count_if((status == "pending_retry") & ~budget).alias("projects_pending_retry"),
        F.count_if((status == "pending_retry") & budget).alias("projects_skipped_budget"),
        F.count_if(status == "unsafe_content").alias("projects_skipped_unsafe"),
        F.count_if(status == "failed").alias("projects_failed"),
        F.coalesce(F.sum(F.when(status == "ok", F.col("cost_usd"))),
                   F.lit(0).cast("decimal(18,6)")).alias("total_cost_usd"))


def evaluation_fact(df: DataFrame, now: dt.datetime, pre_threshold: int = 50, fit_threshold: int = 85) -> DataFrame:
    """One appended fact per evaluated posting; a list rationale becomes bullets."""
    rationale = F.when(F.size("rationale_list") > 0, F.array_join(F.transform(
        "rationale_list", lambda r: F.concat(F.lit("- "), r)), "\n")).otherwise(X.strip(F.col("rationale")))
    return df.select(
        "project_id", F.lit(now).alias("evaluated_at"), "pre_eval_score",
        F.lit(pre_threshold).alias("pre_threshold"), "pre_rationale", "fit_score",
        F.lit(fit_threshold).alias("fit_threshold"), "decision", rationale.alias("rationale"))


def latest_by(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest fact per key as an aggregate; map-side reduction keeps hot keys small."""
    values = [c for c in facts.columns if c not in key]
    return facts.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")) \
        .select(*key, "v.*")


def upsert_scores(scores: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (posting, kind); the newest value stays."""
    return latest_by(scores.unionByName(new), ["project_id", "kind"], ["ts"])
