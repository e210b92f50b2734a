"""Queries over structures built for many questions: substring search by an index, thousands of rules by one automaton."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gleanery.operators import gram_index as GI
from gleanery.operators import many_rules as MR
from gleanery.operators import search as Q
from gleanery.plans.queries import orders_as_articles
from gleanery.plans.registry import ORACLES, query, shared_folder
from gleanery.plans.view_queries import widened

_REQUESTS = ["ther", "data", "token the", "ing nst th", "nowhere the", "ÉAUX", "th"]


@query(
    " UNION ALL ".join(
        f"SELECT '{q}' AS q, doc_id FROM documents WHERE " + " AND ".join(f"contains(lower(text), '{term}')" for term in Q.folded_terms(q)) for q in _REQUESTS
    )
)
def substring_index(t):
    """substrings of whole texts by posting lists of trigrams: frequent, rare and absent terms, and one too short for a trigram."""
    d = t("documents").select("doc_id", "text")
    spark, folder = d.sparkSession, shared_folder(d.sparkSession, "grams")
    GI.write(d.select("doc_id", F.lower("text").alias("folded")), F.col("folded"), folder)
    found = [GI.find(spark, folder, q).select(F.lit(q).alias("q"), "doc_id") for q in _REQUESTS]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


@query(ORACLES["search_view"])
def indexed_search_view(t):
    """The search of ``search_view`` with its terms looked up in an index; texts are folded once, when they are stored."""
    a = orders_as_articles(t).withColumns({"title": widened(F.col("title")), "source_name": widened(F.upper("source_name"))})
    spark, folder = a.sparkSession, shared_folder(a.sparkSession, "articles")
    GI.write(a, Q.search_text(a), folder)
    f = Q.Filters.parse("?q=%EF%BC%91%EF%BC%97+Customer%23&from=1996-01-01&to=1996-12-31&page=2&tag=")
    hits = GI.search(spark, folder, f)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = Q.list_rows(Q.page_of(Q.newest_first(hits), 20, f.page)).select("id", "date", "text", "tags")
    unknown = Q.undated_excluded(GI.find(spark, folder, f.q), replace(f, q="")).select(F.col("n").alias("undated"))
    return page.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(unknown))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _phrases(table: str) -> str:
    """Words and pairs of neighbouring words, with all columns of the table."""
    return f"SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS p FROM {table}"


@query(
    f"""WITH b AS (SELECT 0 AS k, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id AS k, {_WORDS} AS w FROM documents),
r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS pos FROM (SELECT DISTINCT p FROM ({_phrases("b")}))), o AS (SELECT DISTINCT k, p FROM ({_phrases("d")}))
SELECT k AS doc_id, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_rule, CAST(max(pos) AS INTEGER) AS last_rule, CAST(sum(pos) AS BIGINT) AS rules FROM o JOIN r USING (p) GROUP BY k"""
)
def thousands_of_rules(t):
    """A rule for each word and each pair of neighbouring words of the benchmark, over all documents in one pass."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    b = t("benchmark").select(words.alias("w"))
    pairs = F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")), lambda x: F.concat(x["a"], F.lit(" "), x["b"]))
    phrases = b.select(F.explode(F.concat("w", F.array_compact(pairs))).alias("p")).distinct()
    known = sorted(r["p"] for r in phrases.collect())
    rules = [{"tag_id": p, "label": p, "pattern": "(?<![a-z0-9])" + p.replace(" ", "[^a-z0-9]+") + "(?![a-z0-9])"} for p in known]
    d = t("documents").select(F.col("doc_id").alias("article_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    told = [F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_rule"), F.max("pos").alias("last_rule"), F.sum("pos").alias("rules")]
    return MR.matches(d, rules).groupBy(F.col("article_id").alias("doc_id")).agg(*told)
