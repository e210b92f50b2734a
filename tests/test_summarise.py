import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import summaries as SU
from gleanery.plans import summarise as SM
from gleanery.sources import commits

GOOD = {"summary": "s", "key_points": ["p"], "targets": [], "dates": [], "ai_tags": [{"tag_id": "x", "reason": "r"}], "new_tag_suggestions": [], "uncertainties": ["u"]}


def changed(**fields):
    return json.dumps(GOOD | fields, ensure_ascii=False)


CASES = [
    (changed(), None),
    (" " + changed() + "\n", None),
    (None, "fields are missing"),
    ("", "fields are missing"),
    ("sorry, no", "fields are missing"),
    ("[1]", "fields are missing"),
    (json.dumps({k: v for k, v in GOOD.items() if k != "new_tag_suggestions"}), "fields are missing"),
    ("Here it is: " + changed(), "fields are missing"),
    (changed() + " as asked", "fields are missing"),
    (changed() + changed(), "fields are missing"),
    (changed() + '} , {"x": 1', "fields are missing"),
    (changed(extra=1), "the form is wrong"),
    (changed(key_points=[1]), "the form is wrong"),
    (changed(key_points=["a", 1]), "the form is wrong"),
    (changed(key_points="a"), "the form is wrong"),
    (changed(summary=5), "the form is wrong"),
    (changed(summary=None), "the form is wrong"),
    (changed(dates=[{"label": "l", "value": "2026", "evidence": "e", "sure": True}]), "the form is wrong"),
    (changed(dates=[{"label": "l", "value": "2026"}]), "the form is wrong"),
    (changed(dates=[{"label": "l", "value": "2026", "evidence": "e"}, {"label": "l", "value": "2026"}]), "a text is empty"),
    (changed(key_points=["a", None]), "a text is empty"),
    (changed(summary=" 　"), "a text is empty"),
    (changed(new_tag_suggestions=[{"name": " ", "reason": ""}]), "a text is empty"),
    (changed(new_tag_suggestions=[{"name": "n", "reason": ""}]), None),
    (changed(new_tag_suggestions=[{"name": "n", "reason": "", "x": []}]), "the form is wrong"),
    (changed(ai_tags=[{"tag_id": "other", "reason": "r"}]), "tag is not registered"),
    (changed(ai_tags=[{"tag_id": "x", "reason": "r"}, {"tag_id": None, "reason": "r"}]), "a text is empty"),
    (changed(summary="x" * 300), None),
    (changed(summary="x" * 301), "summary is too long"),
    (changed(key_points=["p"] * 6), "too many points"),
    (changed(dates=[{"label": "l", "value": "26-01", "evidence": "e"}]), "a date is malformed"),
    (changed(dates=[{"label": "l", "value": "2026-01", "evidence": "e" * 201}]), "a date is malformed"),
]


def test_answers_are_read_strictly(spark):
    rows = spark.createDataFrame([(k, a, "body") for k, (a, _) in enumerate(CASES)], "article_id int, answer string, text string")
    got = {r["article_id"]: r["problem"] for r in SU.judged_answers(rows, ["x", "y"]).select("article_id", "problem").collect()}
    assert [(a, got[k]) for k, (a, _) in enumerate(CASES)] == CASES


def test_tokens_of_all_attempts_and_waits():
    waits, bad = [], SU.Outcome("ok", "no", 100, 10)
    provider = SU.MockProvider({"k": [bad, SU.Outcome("truncated", "{", 100, 10), SU.Outcome("ok", "{}", 100, 10)]})
    got, retries = SU.with_retries(provider, "k", SU._not_json, 2, waits.append)
    assert (got.kind, got.tokens_in, got.tokens_out, retries, waits) == ("ok", 300, 30, 2, [1.0, 2.0])


class Scripted:
    """Answers by the kind that a prompt names, and by the attempt."""

    def __init__(self, attempt, log):
        self.attempt, self.log = attempt, log

    def complete(self, prompt):
        kind, size = prompt.split()[0], 100
        with open(self.log, "a") as f:
            f.write(f"{prompt.split()[1]} {self.attempt}\n")
        good = SU.Outcome("ok", changed(new_tag_suggestions=[{"name": "n" + prompt.split()[1], "reason": ""}, {"name": "both", "reason": "why"}], dates=[{"label": "l", "value": "2026", "evidence": "absent"}]), size, 10, model="m1")
        if kind == "later":
            return [SU.Outcome("ok", "no", size, 10), SU.Outcome("truncated", "{", size, 10), good][self.attempt]
        return {"good": good, "bad": SU.Outcome("ok", "no", size, 10), "refused": SU.Outcome("refusal", "", size, 1), "down": SU.Outcome("retryable_error"), "wrong": SU.Outcome("api_error")}[kind]


def plain(articles, limits, tokens_of):
    """The rules, one target after another."""
    out, used = {}, 0
    order = sorted(articles, key=lambda a: a[0])
    order.sort(key=lambda a: a[3], reverse=True)
    for k, (key, _, _, _, text) in enumerate(order):
        if text is None:
            continue
        if k >= limits.articles or used + tokens_of(text) > limits.tokens:
            out[key] = ("failed_limit_exceeded", None, 0)
            continue
        kind, tokens, tries = text.split()[0], 0, 0
        status = {"good": "success", "later": "success", "bad": "failed_invalid_output", "refused": "failed_refusal"}.get(kind, "failed_api_error")
        tries = 3 if kind in ("later", "bad", "down") else 1
        tokens = 0 if kind in ("down", "wrong") else 100 * tries
        used += tokens
        out[key] = (status, tokens or None, tries - 1)
    return out


class Stop(Exception):
    pass


def articles_of(n):
    kinds = ["good", "bad", "refused", "later", "down", "wrong"]
    return [(f"a{i}", 1, f"h{i}", f"2026-01-{i % 28 + 1:02d}", None if i % 11 == 5 else f"{kinds[i % 6]} a{i} " + "x" * (i % 5 * 40)) for i in range(n)]


SCHEMA = "article_id string, version int, content_hash string, first_seen_at string, text string"


def run_of(number, **limits):
    return SM.Run(number, "2026-02-01T00:00:00+09:00", "m1", "p1", "t1", ["x", "y"], SM.Limits(**limits), {"m1": (3.0, 15.0)})


def test_a_run_that_is_stopped_after_any_step(spark, tmp_path):
    rows = articles_of(30)
    articles = spark.createDataFrame(rows, SCHEMA)
    limits = {"articles": 24, "tokens": 1500}
    want = plain(rows, SM.Limits(**limits), lambda t: -(-len(t) // 4))
    assert {s for s, *_ in want.values()} == set(SU.STATUSES) - {"skipped_no_api_key"}

    def once(folder, log, seen=None):
        """``seen``: steps after which a run was stopped already; it is stopped after any other one."""
        steps = []

        def after(step):
            steps.append(step)
            if seen is not None and step not in seen:
                seen.add(step)
                raise Stop(step)

        SM.summarise(articles, run_of(1, **limits), folder, f"{folder}-work", lambda a: Scripted(a, log), lambda e: 100, after, lambda s: None)
        return steps

    def told(folder):
        s = commits.snapshot(spark, folder)
        got = {r["article_id"]: (r["analysis_status"], r["input_tokens"], r["retries"]) for r in s.table("records").collect()}
        assert s.table("records").count() == len(got)
        return got, sorted(tuple(r) for r in s.table("candidates").collect()), [tuple(r) for r in s.table("runs").collect()]

    whole = f"file://{tmp_path}/whole"
    steps = once(whole, f"{tmp_path}/whole.log")
    first = told(whole)
    assert first[0] == want and len([s for s in steps if s.startswith("calls/")]) > 3
    calls = sorted(open(f"{tmp_path}/whole.log").read().split("\n"))
    run = first[2][0]
    assert run[2:8] == ("partial", sum(s == "success" for s, *_ in want.values()), sum(s != "success" for s, *_ in want.values()), 0, len(calls) - 1, sum(t or 0 for _, t, _ in want.values()))
    assert [c[0] for c in first[1]].count("both") == 1
    # Stopped after every single step, again and again, until it ends.
    folder, log, seen = f"file://{tmp_path}/broken", f"{tmp_path}/broken.log", set()
    for _ in range(len(steps) + 1):
        try:
            once(folder, log, seen)
        except Stop:
            continue
        break
    assert len(seen) == len(steps) > 6 and told(folder) == first
    assert sorted(open(log).read().split("\n")) == calls
    assert once(folder, log) == []  # the number is in the log
    assert told(folder) == first


def test_the_memo_and_the_next_run(spark, tmp_path):
    rows, folder, log = articles_of(12), f"file://{tmp_path}/set", f"{tmp_path}/log"
    articles = spark.createDataFrame(rows, SCHEMA)
    SM.summarise(articles, run_of(1), folder, f"{tmp_path}/w1", lambda a: Scripted(a, log), pause=lambda s: None)
    SM.summarise(articles, run_of(2), folder, f"{tmp_path}/w2", lambda a: Scripted(a, log), pause=lambda s: None)
    records = commits.snapshot(spark, folder).table("records")
    again = {r["article_id"] for r in records.where("run = 2").collect()}
    assert again == {r["article_id"] for r in records.where("run = 1 and analysis_status <> 'success'").collect()} and again
    SM.summarise(articles, run_of(3), folder, f"{tmp_path}/w3", None)
    third = commits.snapshot(spark, folder).table("records").where("run = 3")
    assert {r["analysis_status"] for r in third.collect()} == {"skipped_no_api_key"} and third.count() == len(again)
    notes = records.where("analysis_status = 'success'").first()["uncertainties"]
    assert notes[0] == "u" and "採用しませんでした" in notes[1]


def test_stream_of_articles(spark, tmp_path):
    rows, source, log = articles_of(18), f"{tmp_path}/in", f"{tmp_path}/log"
    for a in (0, 9):
        spark.createDataFrame(rows[a : a + 9], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        SM.summarise_stream(stream, lambda n: run_of(n), f"{tmp_path}/set", f"{tmp_path}/work", lambda a: Scripted(a, log), pause=lambda s: None).awaitTermination()
    s = commits.snapshot(spark, f"{tmp_path}/set")
    assert s.done == {SM.WRITER: 1} and s.version == 2 and s.table("records").count() == sum(r[4] is not None for r in rows)


def test_waves_decide_as_one_by_one():
    import random

    rng = random.Random(5)
    for _ in range(300):
        places = [(str(k), rng.randint(1, 50), 80) for k in range(rng.randint(0, 25))]
        real, limit = {p[0]: rng.randint(0, 240) for p in places}, rng.randint(0, 1500)
        used, taken, left = 0, [], []
        for key, estimate, _ in places:
            (taken if used + estimate <= limit else left).append(key)
            used += real[key] if key == (taken or [None])[-1] else 0
        assert SM.waves(places, limit, 3, lambda keys: {k: real[k] for k in keys}) == (taken, left)


def test_no_targets(spark, tmp_path):
    s = SM.summarise(spark.createDataFrame([], SCHEMA), run_of(0), f"{tmp_path}/set", f"{tmp_path}/w", lambda a: None)
    assert s.table("records").count() == 0 and s.table("runs").first()["status"] == "success"
    with pytest.raises(Exception):
        s.table("nothing")
