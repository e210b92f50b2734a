"""Summaries by a model: which articles need one, within which budget, how answers are judged and counted."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import squeezed


def latest_summary(summaries: DataFrame) -> DataFrame:
    """The summary of the largest (version, time as text) of each article."""
    return summaries.groupBy("article_id").agg(
        F.max_by(F.struct(*summaries.columns), F.struct("article_version", "processed_at")).alias("s")
    ).select("s.*")


def last_for_version(files: DataFrame) -> DataFrame:
    """The summary appended last for each article and version; ``files``: ``article_id, summaries`` (array)."""
    rows = files.select(F.posexplode("summaries").alias("pos", "s"))
    return rows.groupBy("s.article_id", "s.article_version").agg(F.max_by("s", "pos").alias("s")).select("s.*")


def needs_processing(latest: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Latest versions that were read and whose last summary is not a success under the same cache ``keys``; newest
    first, each once.

    ``latest``: ``article_id, version, extraction_status, first_seen_at`` and the keys; ``done``: ``article_id,
    article_version, analysis_status`` and the keys, and ``pos``, the place in the history, if a version may have
    several summaries (the last one appended counts)."""
    order = "pos" if "pos" in done.columns else None
    fields = F.struct("analysis_status", *(F.col(k).alias("old_" + k) for k in keys))
    last = F.max_by(fields, order) if order else F.first(fields)
    old = done.groupBy("article_id", F.col("article_version").alias("version")).agg(last.alias("__s"))
    same = F.coalesce(F.col("__s.analysis_status") == "success", F.lit(False))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col("__s.old_" + k))
    joined = latest.where("extraction_status = 'ok'").join(old, ["article_id", "version"], "left")
    return joined.where(~same).select(*latest.columns).orderBy(F.col("first_seen_at").desc(), "article_id")


def exact_budget(items: list[tuple[str, bool, int]], most: int, token_limit: int) -> list[str]:
    """Ids taken in order: the item cap counts articles without text too; one that does not fit is passed over and
    later, smaller ones may still fit."""
    used, taken = 0, []
    for key, has_text, tokens in items[:most]:
        if has_text and used + tokens <= token_limit:
            used += tokens
            taken.append(key)
    return taken


def within_budget(targets: DataFrame, order: list[Column], most: int, tokens: str, token_limit: int, has_text: Column | None = None) -> DataFrame:
    """Of the first ``most`` targets those that fit the budget one after another, with the tokens used so far
    (``running``): the rule of ``exact_budget``. A fold over at most ``most`` rows, a parameter, in SQL."""
    first = targets.orderBy(*order).limit(most)
    place = F.row_number().over(W.orderBy(*order))
    row = F.struct(
        place.alias("place"),
        F.col(tokens).cast("long").alias("tokens"),
        F.coalesce(has_text if has_text is not None else F.lit(True), F.lit(False)).alias("text"),
        F.struct(*targets.columns).alias("t"),
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:int,running:bigint>>").alias("taken"))
    listed = first.select(row.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    fits = lambda s, r: r["text"] & (s["used"] + r["tokens"] <= token_limit)
    step = lambda s, r: F.when(
        fits(s, r),
        F.struct(
            (s["used"] + r["tokens"]).alias("used"),
            F.concat(s["taken"], F.array(F.struct(r["place"].alias("place"), (s["used"] + r["tokens"]).alias("running")))).alias("taken"),
        ),
    ).otherwise(s)
    done = listed.select("rows", F.aggregate("rows", start, step)["taken"].alias("taken"))
    return done.select("rows", F.inline("taken")).select(
        F.element_at("rows", F.col("place").cast("int"))["t"].alias("t"),
        "running",
    ).select("t.*", "running")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """In currency units to six places; prices are per million tokens; null if there is none."""
    return F.round(tokens_in / 1_000_000 * price_in + tokens_out / 1_000_000 * price_out, 6)


def plan_estimate(targets: DataFrame, most: int, tokens: str, price_in: float, out_tokens: int, price_out: float) -> DataFrame:
    """How many, how many tokens and at what cost, without calling anything."""
    cut = targets.orderBy(F.col("first_seen_at").desc(), "article_id").limit(most)
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(tokens), F.lit(0))
    return cut.agg(
        n.alias("articles"),
        total.alias("input_tokens"),
        F.round(total / 1e6 * price_in + n * out_tokens / 1e6 * price_out, 6).alias("cost"),
    )


def usage_totals(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(F.col("analysis_status") == "success").alias("summarized"),
        F.count_if(F.col("analysis_status").startswith("failed")).alias("failed"),
        F.count_if(F.col("analysis_status").startswith("skipped")).alias("skipped"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("usage.estimated_cost_usd"), F.lit(0.0)), 6).alias("cost"),
    )


ANSWER = (
    "summary string, key_points array<string>, targets array<string>, dates array<struct<label:string,value:string,evidence:string>>, "
    "ai_tags array<struct<tag_id:string,reason:string>>, new_tag_suggestions array<struct<name:string,reason:string>>, uncertainties array<string>"
)


#: Fixed value: the note on a date whose evidence is not in the text.
UNSUPPORTED_DATE = ("根拠を原文で確認できない日付（", "：", "）は採用しませんでした")
#: Fixed value: the accepted form of dates in answers.
_ANSWER_DATE = r"^\d{4}(-\d{2}(-\d{2})?)?$"


def _exact_form(ddl: T.StructType) -> str:
    """A pattern of the types that ``schema_of_variant`` tells of values with exactly these fields, in any list perhaps none."""

    def of(kind: T.DataType) -> str:
        if isinstance(kind, T.ArrayType):
            return f"ARRAY<(?:VOID|{of(kind.elementType)})>"
        if isinstance(kind, T.StructType):
            return "OBJECT<" + ", ".join(f"{f.name}: {of(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
        return "STRING"

    return of(ddl)


def strict_problem(answer: Column, parsed: Column, tag_ids: list[str], most: int, points: int, evidence: int) -> Column:
    """The first rule that an answer breaks, or null. ``parsed``: the same as ``ANSWER``, read leniently.

    The whole text must be one JSON object with all fields of ``ANSWER``, no other ones at any level, and strings where strings
    belong: read as a variant beside a second field, its types say whether a field has another name or kind and whether
    anything follows it. What lists hold is then tested one by one, so a field that some elements lack is found too."""
    form = _exact_form(T._parse_datatype_string(ANSWER))
    whole = F.concat(F.lit('{"answer":'), answer, F.lit(',"end":0}'))
    types = F.schema_of_variant(F.try_parse_json(whole))
    keys = F.json_object_keys(answer)
    names = [f.name for f in T._parse_datatype_string(ANSWER).fields]
    blank = lambda c: ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
    some_blank = lambda c: F.exists(parsed[c], blank)
    lacks = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), keys)) > 0, F.lit(True))
    unknown = F.coalesce(F.exists(parsed["ai_tags"], lambda t: t["tag_id"].isNotNull() & ~t["tag_id"].isin(tag_ids)), F.lit(False))
    return (
        F.when(answer.isNull() | types.isNull() | ~types.rlike("^OBJECT<answer: OBJECT<.*>, end: BIGINT>$") | lacks, "fields are missing")
        .when(unknown, "tag is not registered")
        .when(~types.rlike(rf"^OBJECT<answer: {form}, end: BIGINT>$"), "the form is wrong")
        .when(blank(parsed["summary"]) | some_blank("key_points") | some_blank("targets") | some_blank("uncertainties"), "a text is empty")
        .when(F.length(parsed["summary"]) > most, "summary is too long")
        .when(F.size(parsed["key_points"]) > points, "too many points")
        .when(F.exists(parsed["ai_tags"], lambda t: t["tag_id"].isNull() | blank(t["reason"])), "a text is empty")
        .when(F.exists(parsed["new_tag_suggestions"], lambda t: blank(t["name"]) | t["reason"].isNull()), "a text is empty")
        .when(F.exists(parsed["dates"], lambda d: blank(d["label"]) | blank(d["evidence"])), "a text is empty")
        .when(
            F.exists(parsed["dates"], lambda d: ~F.coalesce(d["value"].rlike(_ANSWER_DATE), F.lit(False)) | (F.length(d["evidence"]) > evidence)),
            "a date is malformed",
        )
    )


def judged_answers(answers: DataFrame, tag_ids: list[str], most: int = 300, points: int = 5, evidence: int = 200) -> DataFrame:
    """Parsed answers (``article_id, answer, text``) with ``problem``, the first rule that they break (``strict_problem``), or
    null; of good ones the fields that count, ``tags`` and ``dates``, and ``notes`` to be added to the uncertainties.

    Repeated tags are merged, the first stays. Dates whose evidence is not in the text (both NFKC without white space)
    are left out with a note; neither rejects the answer. An object that repeats a key is not read."""
    parsed = answers.withColumn("a", F.from_json("answer", ANSWER))
    problem = strict_problem(F.col("answer"), F.col("a"), tag_ids, most, points, evidence)
    judged = parsed.withColumn("problem", problem)
    good = F.col("problem").isNull()
    # NFKC of evidence is one call a row: the parts travel as one text, cut apart again at a mark no text holds.
    parts = F.array_join(
        F.transform(
            F.coalesce("a.dates", F.array().cast("array<struct<label:string,value:string,evidence:string>>")),
            lambda d: F.coalesce(d["evidence"], F.lit("")),
        ),
        "\x00",
    )
    bare = judged.withColumn("__text", squeezed(F.col("text"))).withColumn("__evidence", F.split(squeezed(parts), "\x00"))
    there = F.transform("a.dates", lambda d, k: F.struct(d.alias("d"), F.contains(F.col("__text"), F.get(F.col("__evidence"), k)).alias("ok")))
    left, colon, right = UNSUPPORTED_DATE
    note = lambda x: F.concat(F.lit(left), x["d"]["label"], F.lit(colon), x["d"]["value"], F.lit(right))
    tags = F.filter("a.ai_tags", lambda t, k: F.array_position(F.transform("a.ai_tags", lambda x: x["tag_id"]), t["tag_id"]) == k + 1)
    return bare.withColumn("__dates", there).select(
        *judged.columns,
        F.when(good, tags).alias("tags"),
        F.when(good, F.transform(F.filter("__dates", lambda x: x["ok"]), lambda x: x["d"])).alias("dates"),
        F.when(good, F.transform(F.filter("__dates", lambda x: ~x["ok"]), note)).alias("notes"),
    )


def evidence_found(evidence: DataFrame, texts: DataFrame, key: str = "article_id") -> DataFrame:
    """``evidence`` (``key, evidence``) with ``found``: whether its own article's ``text`` holds it, both NFKC without
    white space."""
    joined = evidence.join(texts.select(key, "text"), key)
    return joined.withColumn("found", F.contains(squeezed(F.col("text")), squeezed(F.col("evidence")))).drop("text")


#: What can become of a target.
STATUSES = ("success", "failed_invalid_output", "failed_refusal", "failed_api_error", "failed_limit_exceeded", "skipped_no_api_key")


def record(status: Column, answer: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Answer fields of a summary record: null, not empty, for anything but a success; zero tokens are unknown."""
    fields = ("summary", "key_points", "targets", "dates", "ai_tags", "uncertainties")
    return F.struct(
        status.alias("analysis_status"),
        *(F.when(status == "success", answer[c]).alias(c) for c in fields),
        F.nullif(tokens_in, F.lit(0)).alias("input_tokens"),
        F.nullif(tokens_out, F.lit(0)).alias("output_tokens"),
    )


@dataclass
class Outcome:
    """ok, refusal, truncated, api_error or retryable_error, with what came back and the model that answered, if told."""

    kind: str
    text: str = ""
    tokens_in: int = 0
    tokens_out: int = 0
    detail: str = ""
    model: str | None = None


class Provider(Protocol):
    def complete(self, prompt: str) -> Outcome: ...


class MockProvider:
    """Answers from a table by what a prompt contains; else a fixed empty answer. No network."""

    def __init__(self, answers: dict[str, list[Outcome]] | None = None):
        self.answers, self.calls = {k: list(v) for k, v in (answers or {}).items()}, 0

    def complete(self, prompt: str) -> Outcome:
        self.calls += 1
        for mark, outcomes in self.answers.items():
            if mark in prompt and outcomes:
                return outcomes.pop(0) if len(outcomes) > 1 else outcomes[0]
        empty = {"summary": "", "key_points": [], "targets": [], "dates": [], "ai_tags": [], "uncertainties": []}
        return Outcome("ok", json.dumps(empty), len(prompt) // 4, 20)


def backoff(attempt: int, most: float = 30) -> float:
    return min(2.0**attempt, most)


def with_retries(
    provider: Provider,
    prompt: str,
    valid: Callable[[str], str | None],
    most: int = 2,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[Outcome, int]:
    """The last outcome, with the tokens of all attempts, and how many retries it took. Invalid and truncated answers and
    passing errors are tried again after a wait, refusals and other errors are not."""
    tokens_in = tokens_out = 0
    for attempt in range(most + 1):
        outcome = provider.complete(prompt)
        tokens_in, tokens_out = tokens_in + outcome.tokens_in, tokens_out + outcome.tokens_out
        outcome = replace(outcome, tokens_in=tokens_in, tokens_out=tokens_out)
        problem = valid(outcome.text) if outcome.kind == "ok" else outcome.kind
        if problem is None or outcome.kind in ("refusal", "api_error") or attempt == most:
            break
        sleep(backoff(attempt))
    return (outcome if problem is None or outcome.kind != "ok" else replace(outcome, kind="invalid", detail=problem)), attempt


def completed(prompts: DataFrame, make_provider: Callable[[], Provider], most: int = 2, pause: bool = True) -> DataFrame:
    """``article_id, kind, text, tokens_in, tokens_out, retries`` of ``article_id, prompt``; one provider a task. Without
    ``pause`` retries do not wait."""
    wait = time.sleep if pause else lambda seconds: None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["article_id"], batch["prompt"]):
                o, n = with_retries(provider, prompt, _not_json, most, wait)
                rows.append((key, o.kind, o.text, o.tokens_in, o.tokens_out, n))
            yield pd.DataFrame(rows, columns=["article_id", "kind", "text", "tokens_in", "tokens_out", "retries"])

    return prompts.select("article_id", "prompt").mapInPandas(
        run,
        "article_id string, kind string, text string, tokens_in long, tokens_out long, retries int",
    )


def _not_json(text: str) -> str | None:
    try:
        return None if isinstance(json.loads(text), dict) else "not an object"
    except ValueError:
        return "not JSON"


def new_tag_names(found: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed tag names that are not known yet, each once with its earliest proposal."""
    fresh = found.join(known.select("name").distinct(), "name", "left_anti")
    return fresh.groupBy("name").agg(F.min_by(F.struct(*[c for c in found.columns if c != "name"]), "first_seen_at").alias("f")).select("name", "f.*")
