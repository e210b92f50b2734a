"""One run of summaries from targets to committed records, which may be stopped anywhere and started again.

A run is a transaction with a number. What it has worked out is kept step by step in a folder of its own: the targets, each
attempt at calling the model, the records. A step that has finished is read, not done again, so a run that is started again
pays no finished call twice and counts the tokens of all attempts. The last step puts records, proposed tags and the run's totals
into a set of tables (``sources.commits``) under its number; a number that is there already changes nothing.

Which targets need a call is looked up in the set's own records, keyed by content hash, model, prompt and tags (the memo).
Calls go in waves: of the run's targets (``Limits.articles`` at most, newest first) a wave has those that fit the budget
whatever the attempts before them may use; then the tokens really used are counted and the next wave is chosen, which gives the
decisions of a run that calls one after another. An attempt of a wave is one Spark job, judged by Spark; what is to be tried
again goes into the next attempt, after one wait for all.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions import text
from gleanery.operators import summaries as SU
from gleanery.sources import commits

#: The writer's name in the log of the set.
WRITER = "summarise"
#: Wording of records.
TRUNCATED_NOTE = ("本文が長いため、先頭", "文字だけで作成しました")
NO_REASON = "（理由なし）"
ERRORS = {"articles": "1回の処理件数の上限を超えたため未処理", "tokens": "1回の入力トークンの上限を超えるため未処理", "key": "APIキーが設定されていません"}


@dataclass(frozen=True)
class Limits:
    """Targets of a run, characters of a text, input tokens of a run, retries of a call, length of tag names and reasons."""

    articles: int = 60
    chars: int = 20_000
    tokens: int = 1_000_000
    retries: int = 2
    name: int = 100
    reason: int = 300


@dataclass(frozen=True)
class Run:
    """What a run is made with: the memo's keys, the tags that answers may name, limits and prices (per million tokens)."""

    number: int
    now: str
    model: str
    prompt_version: str
    tags_version: str
    tag_ids: list[str]
    limits: Limits = Limits()
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)


#: The memo's keys.
KEYS = ["content_hash", "model", "prompt_version", "tags_version"]
_CALL = "article_id string, attempt int, kind string, answer string, tokens_in long, tokens_out long, model string"


def estimated_tokens(prompt: Column) -> Column:
    """A guess without asking the model: four characters a token."""
    return F.ceil(F.length(prompt) / 4)


def open_targets(articles: DataFrame, snapshot: commits.Snapshot, run: Run) -> DataFrame:
    """``article_id, version, content_hash, first_seen_at, text, prompt, tokens, truncated`` of the articles (latest version
    read, ``text`` null if its cache is lost) whose last record for the version is no success under the run's keys."""
    keyed = articles.withColumns({"model": F.lit(run.model), "prompt_version": F.lit(run.prompt_version), "tags_version": F.lit(run.tags_version)})
    if "records" in snapshot.tables:
        records = snapshot.table("records").withColumnRenamed("run", "pos")
        keyed = SU.needs_processing(keyed.withColumn("extraction_status", F.lit("ok")), records, KEYS)
    prompt = text.prompt_text(F.col("text"), run.limits.chars)
    return keyed.select(
        "article_id",
        "version",
        "content_hash",
        "first_seen_at",
        "text",
        prompt.alias("prompt"),
        estimated_tokens(prompt).alias("tokens"),
        (F.length("text") > run.limits.chars).alias("truncated"),
    )


def called(targets: DataFrame, make_provider: Callable[[int], SU.Provider], attempt: int) -> DataFrame:
    """One call for each target: ``article_id, attempt, kind, answer, tokens_in, tokens_out, model``; one provider a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider(attempt)
        for batch in batches:
            got = [(k, attempt, o.kind, o.text, o.tokens_in, o.tokens_out, o.model) for k, o in ((k, provider.complete(p)) for k, p in zip(batch["article_id"], batch["prompt"]))]
            yield pd.DataFrame(got, columns=[c.split()[0] for c in _CALL.split(", ")])

    return targets.select("article_id", "prompt").mapInPandas(run, _CALL)


def judged(calls: DataFrame, targets: DataFrame, run: Run) -> DataFrame:
    """Calls with ``status`` and ``error``, and of good answers what counts of them; ``again``: whether to try once more."""
    asked = calls.join(targets.select("article_id", F.substring("text", 1, run.limits.chars).alias("text")), "article_id")
    told = SU.judged_answers(asked.withColumn("answer", F.when(F.col("kind") == "ok", F.col("answer"))), run.tag_ids)
    kind, good = F.col("kind"), F.col("problem").isNull() & (F.col("kind") == "ok")
    status = F.when(good, "success").when(kind.isin("ok", "truncated"), "failed_invalid_output").when(kind == "refusal", "failed_refusal").otherwise("failed_api_error")
    answer = F.struct("a.summary", "a.key_points", "a.targets", "dates", F.col("tags").alias("ai_tags"), F.concat("a.uncertainties", "notes").alias("uncertainties"))
    return told.select(
        *(c.split()[0] for c in _CALL.split(", ") if c != "answer string"),
        status.alias("status"),
        F.when(~good, F.when(kind == "ok", F.col("problem")).otherwise(kind)).alias("error"),
        F.when(good, answer).alias("answer"),
        F.when(good, F.col("a.new_tag_suggestions")).alias("suggestions"),
        (~good & ~kind.isin("refusal", "api_error")).alias("again"),
    )


def waves(places: list[tuple[str, int, int]], limit: int, attempts: int, call: Callable[[list[str]], dict[str, int]]) -> tuple[list[str], list[str]]:
    """Ids that are called and ids left out for the budget, of ``(id, estimate, most)`` in order: a target is called if its
    estimate fits beside the tokens used by those before. ``call`` makes the calls of a wave and tells the tokens used."""
    used, taken, left, wave, could, k = 0, [], [], [], 0, 0
    while k < len(places) or wave:
        if k < len(places):
            key, estimate, most = places[k]
            if used + could + estimate <= limit:  # fits whatever the wave uses
                wave.append(key)
                could += attempts * most
                k += 1
                continue
            if not wave:  # all tokens used are known
                left.append(key)
                k += 1
                continue
        spent = call(wave)
        used += sum(spent.values())
        taken, wave, could = taken + wave, [], 0
    return taken, left


def summarise(
    articles: DataFrame,
    run: Run,
    folder: str,
    work: str,
    make_provider: Callable[[int], SU.Provider] | None,
    most_tokens: Callable[[int], int] = lambda estimate: 2 * estimate + 1000,
    after: Callable[[str], None] = lambda step: None,
    pause: Callable[[float], None] = time.sleep,
) -> commits.Snapshot:
    """Run number ``run.number`` over ``articles`` (``article_id, version, content_hash, first_seen_at, text``) into the set
    of tables below ``folder``: ``records``, ``candidates`` and ``runs``.

    ``work``: this run's own folder, the same when it is started again. ``make_provider`` gets the number of the attempt; without
    one every target is skipped for want of a key. ``most_tokens``: the most input tokens that a call of an estimate may be
    charged, which bounds waves only. ``after`` is told each finished step. Articles whose text is lost get no record."""
    spark, limits = articles.sparkSession, run.limits
    before = commits.snapshot(spark, folder)
    if before.done.get(WRITER, -1) >= run.number:
        return before

    def kept(name: str, df: Callable[[], DataFrame]) -> DataFrame:
        path = f"{work}/{name}"
        if not commits.exists(spark, f"{path}/_SUCCESS"):
            df().write.mode("overwrite").parquet(path)
            after(name)
        return spark.read.parquet(path)

    targets = kept("targets", lambda: open_targets(articles, before, run))
    # At most ``limits.articles`` rows of an id and two numbers.
    newest = [F.col("first_seen_at").desc(), F.col("article_id")]
    first = targets.orderBy(*newest).limit(limits.articles).select("article_id", F.col("text").isNotNull().alias("has"), "tokens").collect()
    places = [(r["article_id"], r["tokens"], most_tokens(r["tokens"])) for r in first if r["has"]]
    made: list[DataFrame] = []
    def ids(keys: list[str]) -> DataFrame:
        return spark.createDataFrame([(k,) for k in keys], "article_id string")

    # What a run may call is read by every wave: a table of its own.
    mine = kept("chosen", lambda: targets.join(F.broadcast(ids([k for k, _, _ in places])), "article_id"))

    def call(keys: list[str]) -> dict[str, int]:
        wave, pending, spent = len(made), keys, dict.fromkeys(keys, 0)
        for attempt in range(limits.retries + 1):
            def asked(pending=pending, attempt=attempt):
                chosen = mine.join(F.broadcast(ids(pending)), "article_id").repartition(min(len(pending), spark.sparkContext.defaultParallelism))
                return called(chosen, make_provider, attempt)

            # Calls are kept as they came, so that no judgement has to call again; then they are judged.
            raw = kept(f"calls/{wave}.{attempt}", asked)
            result = kept(f"judged/{wave}.{attempt}", lambda raw=raw: judged(raw, mine, run))
            made.append(result)
            told = result.select("article_id", "tokens_in", "again").collect()
            for r in told:
                spent[r["article_id"]] += r["tokens_in"]
            pending = [r["article_id"] for r in told if r["again"]]
            if not pending or attempt == limits.retries:
                break
            pause(SU.backoff(attempt))
        return spent

    if make_provider is None:
        taken, left = [], []
        rest = targets.where("text is not null").select("article_id", F.lit("skipped_no_api_key").alias("status"), F.lit(ERRORS["key"]).alias("error"))
    else:
        taken, left = waves(places, limits.tokens, limits.retries + 1, call)
        within = F.broadcast(ids([r["article_id"] for r in first]))
        beyond = targets.where("text is not null").join(within, "article_id", "left_anti").select("article_id", F.lit(ERRORS["articles"]).alias("error"))
        rest = beyond.unionByName(ids(left).withColumn("error", F.lit(ERRORS["tokens"]))).withColumn("status", F.lit("failed_limit_exceeded"))

    records = kept("records", lambda: _records(targets, made, rest, run))
    known = before.table_or_empty("candidates", _proposed(records, run))
    fresh = kept("candidates", lambda: SU.new_tag_names(_proposed(records, run), known))
    totals = kept("runs", lambda: _totals(records, run))
    columns = [c for c in records.columns if c not in ("suggestions", "requests")]
    entries = {
        "records": commits.staged(records.select(*columns), f"{work}/to/records"),
        "candidates": commits.staged(fresh, f"{work}/to/candidates"),
        "runs": commits.staged(totals, f"{work}/to/runs"),
    }
    after("staged")
    return commits.append_once(spark, folder, entries, WRITER, run.number)


def _records(targets: DataFrame, made: list[DataFrame], rest: DataFrame, run: Run) -> DataFrame:
    """A record for each target that was called (its last attempt, the tokens of all) or left out."""
    known = targets.select("article_id", F.col("version").alias("article_version"), "content_hash", "truncated")
    served = F.lit(None).cast("string")
    keys = {"prompt_version": F.lit(run.prompt_version), "tags_version": F.lit(run.tags_version), "run": F.lit(run.number), "processed_at": F.lit(run.now)}
    left = rest.select(
        "article_id", "status", "error", F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(0).alias("retries"),
        F.lit(0).cast("long").alias("requests"), served.alias("served"), F.lit(None).cast(_ANSWER).alias("answer"), F.lit(None).cast(_SUGGESTIONS).alias("suggestions"),
    )
    every = left
    for calls in made:
        every = every.unionByName(calls.select("article_id", "status", "error", "tokens_in", "tokens_out", F.col("attempt").alias("retries"), F.lit(1).cast("long").alias("requests"), F.col("model").alias("served"), "answer", "suggestions"))
    last = lambda c: F.max_by(c, "retries").alias(c)
    done = every.groupBy("article_id").agg(
        *map(last, ("status", "error", "answer", "suggestions")),
        F.max_by("served", F.when(F.col("served").isNotNull(), F.col("retries"))).alias("served"),
        *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "requests")),
        F.max("retries").alias("retries"),
    )
    rows = done.join(known, "article_id").withColumns({"model": F.coalesce("served", F.lit(run.model)), **keys})
    begin, end = TRUNCATED_NOTE
    note = F.when(F.col("truncated"), F.array(F.lit(f"{begin}{run.limits.chars}{end}"))).otherwise(F.array().cast("array<string>"))
    answer = F.col("answer").withField("uncertainties", F.concat("answer.uncertainties", note))
    fields = SU.record(F.col("status"), answer, F.col("tokens_in"), F.col("tokens_out"))
    priced = F.lit(None).cast("double")
    for name, (price_in, price_out) in run.prices.items():
        cost = SU.cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(price_in), F.lit(price_out))
        priced = F.when(F.coalesce(F.when(F.col("served").isin(*run.prices), F.col("served")), F.lit(run.model)) == name, cost).otherwise(priced)
    return rows.withColumn("r", fields).select(
        "article_id", "article_version", "content_hash", "error", "r.*", "retries", F.when(F.col("requests") > 0, priced).alias("estimated_cost_usd"),
        F.col("truncated").alias("input_truncated"), "model", "prompt_version", "tags_version", "run", "processed_at", "suggestions", "requests",
    )


_SUGGESTIONS = "array<struct<name:string,reason:string>>"
_ANSWER = (
    "struct<summary:string,key_points:array<string>,targets:array<string>,dates:array<struct<label:string,value:string,evidence:string>>,"
    "ai_tags:array<struct<tag_id:string,reason:string>>,uncertainties:array<string>>"
)


def _proposed(records: DataFrame, run: Run) -> DataFrame:
    """``name, reason, article_id, first_seen_at`` of tags that answers propose, cut to their limits."""
    s = records.select("article_id", "processed_at", F.inline("suggestions"))
    reason = F.substring("reason", 1, run.limits.reason)
    return s.select(
        F.substring("name", 1, run.limits.name).alias("name"),
        F.when(reason == "", NO_REASON).otherwise(reason).alias("reason"),
        "article_id",
        F.concat(F.col("processed_at"), F.lit(" "), F.col("article_id")).alias("first_seen_at"),
    )


def _totals(records: DataFrame, run: Run) -> DataFrame:
    """One row: what the run did, and with how many calls and tokens."""
    status = F.col("analysis_status")
    counts = records.agg(
        F.count_if(status == "success").alias("summarized"),
        F.count_if(status.startswith("failed")).alias("failed"),
        F.count_if(status.startswith("skipped")).alias("skipped"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    bad = F.col("failed") + F.col("skipped")
    ended = F.when(bad == 0, "success").when(F.col("summarized") == 0, "failed").otherwise("partial")
    price_in, price_out = run.prices.get(run.model, (None, None))
    cost = SU.cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in).cast("double"), F.lit(price_out).cast("double"))
    return counts.select(F.lit(run.number).alias("run"), F.lit(run.now).alias("started_at"), ended.alias("status"), "*", cost.alias("estimated_cost_usd"))


def summarise_stream(arrivals: DataFrame, make_run: Callable[[int], Run], folder: str, work: str, make_provider: Callable[[int], SU.Provider], **options) -> StreamingQuery:
    """Runs over a stream of articles, one for each micro-batch. The batch's number is the run's: a batch that is given again
    after a stop goes on where it was, or changes nothing if it was committed."""

    def batch(df: DataFrame, number: int) -> None:
        summarise(df, make_run(number), folder, f"{work}/run={number}", make_provider, **options)

    writer = arrivals.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True)
    return writer.foreachBatch(batch).start()
