"""Sources over time: runs, counters, failures in a row, sudden drops, retry queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COUNTERS = ["new", "changed", "unchanged", "date_unknown", "fetch_failed"]


def run_totals(run_sources: DataFrame) -> DataFrame:
    """Counters of each run summed over its sources."""
    return run_sources.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def run_status(run_sources: DataFrame, runs: DataFrame) -> DataFrame:
    """failed if all sources failed, partial if any did or any fetch failed, else success; no source at all: success."""
    seen = run_sources.groupBy("run_id").agg(
        F.every(F.col("status") == "failed").alias("all"),
        F.some((F.col("status") == "failed") | (F.col("fetch_failed") > 0)).alias("any"),
    )
    status = F.when(F.coalesce("all", F.lit(False)), "failed").when(F.coalesce("any", F.lit(False)), "partial").otherwise("success")
    return runs.select("run_id").join(seen, "run_id", "left").select("run_id", status.alias("status"))


def consecutive_failures(attempts: DataFrame, key: str, order: list[str], failed: str) -> DataFrame:
    """How many of a key's last attempts failed in a row.

    Attempts after the last success are counted in two aggregations; no window holds a key's whole history."""
    place = F.struct(*order)
    last = attempts.groupBy(key).agg(F.max(F.when(~F.col(failed), place)).alias("last_success"))
    after = F.col("last_success").isNull() | (place > F.col("last_success"))
    return attempts.join(last, key).groupBy(key).agg(F.count_if(F.col(failed) & after).alias("consecutive_failures"))


def last_success(attempts: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """Last attempt with its status, and last success, of each key; success does not move back on failures."""
    return attempts.groupBy(key).agg(
        F.max(at).alias("last_attempt_at"),
        F.max_by(status, at).alias("last_attempt_status"),
        F.max(F.when(F.col(status) == "success", F.col(at))).alias("last_success_at"),
    )


def drops(history: DataFrame, key: str, order: str, count: str, share: float = 0.5, least: int = 4) -> DataFrame:
    """Rows with fewer than ``share`` of the candidates of the row before, if that had ``least`` at least."""
    before = F.lag(count).over(W.partitionBy(key).orderBy(order))
    return history.withColumn("previous", before).where((F.col("previous") >= least) & (F.col(count) < F.col("previous") * share))


def explored(candidates: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """First and last day over all dated candidates of a key, those out of the period included."""
    return candidates.groupBy(key).agg(F.min(lo).alias("oldest"), F.max(hi).alias("newest"))


def retry_queue(old: DataFrame, resolved: DataFrame, failed: DataFrame) -> DataFrame:
    """Old items that were not resolved, and failures: attempts go up, the first failure's time stays.

    ``old``: ``source_id, url, stage, reason, first_failed_at, attempts``; ``resolved``: ``source_id, url``;
    ``failed``: ``source_id, url, stage, reason, failed_at``."""
    kept = old.join(resolved, ["source_id", "url"], "left_anti")
    renamed = kept.select("source_id", "url", *(F.col(c).alias("old_" + c) for c in ("stage", "reason", "first_failed_at", "attempts")))
    both = renamed.join(failed, ["source_id", "url"], "full")
    tried = F.col("failed_at").isNotNull()
    return both.select(
        "source_id",
        "url",
        F.coalesce("stage", "old_stage").alias("stage"),
        F.coalesce("reason", "old_reason").alias("reason"),
        F.coalesce("old_first_failed_at", "failed_at").alias("first_failed_at"),
        (F.coalesce("old_attempts", F.lit(0)) + tried.cast("int")).alias("attempts"),
    )


#: Stages whose failures are tried again by fetching.
FETCH_STAGES = ("fetch", "extract")


def with_retries(candidates: DataFrame, retries: DataFrame) -> DataFrame:
    """Candidates, and the URLs to fetch again that are not among them."""
    again = retries.where(F.col("stage").isin(*FETCH_STAGES)) if "stage" in retries.columns else retries
    return candidates.select("source_id", "url").unionByName(again.select("source_id", "url").join(candidates, ["source_id", "url"], "left_anti"))


def worth_fetching(candidates: DataFrame, retries: DataFrame) -> DataFrame:
    """Candidates whose listed date (``judged``) is not out of the period, or that are to be tried again."""
    out = candidates.where(F.coalesce("judged", F.lit(True)))
    again = candidates.where(~F.coalesce("judged", F.lit(True))).join(
        retries.select("source_id", "url").distinct(),
        ["source_id", "url"],
        "left_semi",
    )
    return out.unionByName(again)


def merged_state(sources: DataFrame, state: DataFrame, results: DataFrame) -> DataFrame:
    """State of each configured source after a run; a source that was never seen starts empty.

    ``results``: ``source_id, status, attempted_at`` and maybe ``explored_range, retry_queue``, what the run found and
    left. The success point and the explored range move only on success; a skipped source keeps all but its attempt;
    the queue is what the run left, whether it failed or not."""
    more = [c for c in ("explored_range", "retry_queue") if c in results.columns]
    joined = sources.select("source_id").join(state, "source_id", "left").join(
        results.select("source_id", F.col("status").alias("now"), "attempted_at", *(F.col(c).alias("new_" + c) for c in more)),
        "source_id",
        "left",
    )
    ok, tried = F.col("now") == "success", F.col("now").isin("success", "failed")
    later = {
        "explored_range": F.when(ok, F.col("new_explored_range")).otherwise(F.col("explored_range")),
        "retry_queue": F.when(tried, F.col("new_retry_queue")).otherwise(F.col("retry_queue")),
    } if more else {}
    return joined.select(
        "source_id",
        F.when(ok, F.col("attempted_at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.coalesce("attempted_at", "last_attempt_at").alias("last_attempt_at"),
        F.coalesce("now", "last_attempt_status").alias("last_attempt_status"),
        F.when(ok, 0).when(
            F.col("now") == "failed",
            F.coalesce("consecutive_failures", F.lit(0)) + 1,
        ).otherwise(F.coalesce("consecutive_failures", F.lit(0))).alias("consecutive_failures"),
        *(later[c].alias(c) for c in more),
    )


def run_warnings(results: DataFrame, previous: DataFrame, most_items: int) -> DataFrame:
    """``source_id, warnings`` of a run in their order. ``results``: ``source_id, listed`` (candidates of the list),
    ``unique`` (URLs), ``merged``, ``rejected``, ``error`` (of the list), ``reextracted``; ``previous``: ``source_id,
    candidates`` of the run before. Fixed values: the wording."""
    row = results.join(previous.select("source_id", F.col("candidates").alias("before")), "source_id", "left")
    listed = F.col("error").isNull()
    fell = listed & (F.col("before") >= 4) & (F.col("unique") < F.col("before") * 0.5)
    kinds = [
        F.when(F.col("merged") > 0, F.concat(F.lit("同じURLを指す一覧の項目 "), "merged", F.lit("件を1件にまとめました（#以降だけが違うリンクなど）"))),
        F.when(F.col("rejected") > 0, F.concat(F.lit("取得対象外のリンク "), "rejected", F.lit("件を除外しました（http(s)以外など）"))),
        F.when(F.col("unique") > most_items, F.concat(F.lit("取得上限（"), F.lit(most_items).cast("string"), F.lit("件）に達したため、残りは次回に回します"))),
        F.when(listed & (F.col("listed") == 0), "一覧から記事を1件も抽出できませんでした（抽出規則が壊れている可能性があります）"),
        F.when(fell, F.concat(F.lit("候補が前回（"), "before", F.lit("件）から"), "unique", F.lit("件に大きく減りました"))),
        F.when(F.col("reextracted") > 0, F.concat(F.lit("抽出方法の変更（添付PDFを読む等）により "), "reextracted", F.lit("件に版を追加しました（原文の変更ではありません）"))),
    ]
    return row.select("source_id", F.array_compact(F.array(*kinds)).alias("warnings"))


def head(candidates: DataFrame, most: int = 10) -> DataFrame:
    """A dry run: the first ``most`` candidates of each source in list order, and ``more``, how many are left out."""
    w = W.partitionBy("source_id")
    numbered = candidates.withColumn("__n", F.row_number().over(w.orderBy("position"))).withColumn(
        "more",
        F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)),
    )
    return numbered.where(F.col("__n") <= most).drop("__n")


def chosen_sources(sources: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Enabled sources, or those named; an unknown id is an error."""
    if not ids:
        return sources.where("enabled")
    known = {r["source_id"] for r in sources.where(F.col("source_id").isin(ids)).select("source_id").collect()}
    if set(ids) - known:
        raise ValueError(f"unknown sources: {sorted(set(ids) - known)}")
    return sources.where(F.col("source_id").isin(ids))
