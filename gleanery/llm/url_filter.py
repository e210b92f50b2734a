"""URL filter: a sorted array of 64-bit xxhash keys, memory-mapped and probed by vectorised binary search.

The array and the rules' strings are two files, written once to the shared folder and handed to every executor
through ``addFile``; each Python worker maps them read-only, so all workers of a machine share the pages. A key that
is found only nominates a rule: the stored string must equal the probed one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import lean, work_dir, write_bytes

#: Host, path and verdict of each rule of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


class RuleIndex:
    """Sorted keys with, in the same order, verdicts and strings; loaded from the files that ``build`` writes."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, body: np.ndarray, lengths: list[int]):
        self.keys, self.offsets, self.body, self.lengths = keys, offsets, body, lengths

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]], key=_key) -> bytes:
        """The file: four numbers, then sorted keys, string offsets, path lengths that occur, strings with verdicts.

        The later of two rules with the same host and path holds.
        """
        last = {host.translate(_FOLD) + path: (len(path), verdict) for host, path, verdict in rules}
        order = sorted(last, key=lambda s: (key(s), s))
        blobs = [("+" if last[s][1] == "allow" else "-").encode() + s.encode("utf-8", "surrogatepass") for s in order]
        lengths = sorted({n for n, _ in last.values()})
        head = np.array([len(order), len(lengths), sum(map(len, blobs)), 0], "<u8")
        offsets = np.cumsum([0, *map(len, blobs)]).astype("<u8")
        return head.tobytes() + np.array([key(s) for s in order], "<u8").tobytes() + offsets.tobytes() + np.array(lengths, "<u8").tobytes() + b"".join(blobs)

    @classmethod
    def load(cls, path: str) -> "RuleIndex":
        n, m, size, _ = map(int, np.fromfile(path, "<u8", 4))
        words = np.memmap(path, "<u8", "r", 32, (2 * n + 1 + m,))
        body = np.memmap(path, "u1", "r", 32 + 8 * (2 * n + 1 + m), (size,)) if size else np.zeros(0, "u1")
        return cls(words[:n], words[n : 2 * n + 1], body, words[2 * n + 1 :].tolist())

    def find(self, probes: list[str], key=_key) -> list[str | None]:
        """For each probe '+' or '-' if it is a rule's string, else None. Equal keys are walked through."""
        if not len(self.keys) or not probes:
            return [None] * len(probes)
        wanted = np.fromiter(map(key, probes), "<u8", len(probes))
        at = np.searchsorted(self.keys, wanted)
        inside = at < len(self.keys)
        found: list[str | None] = [None] * len(probes)
        hit = np.flatnonzero(inside)
        for i in hit[self.keys[at[hit]] == wanted[hit]].tolist():
            target, k = probes[i].encode("utf-8", "surrogatepass"), int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                stored = self.body[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()
                if stored[1:] == target:
                    found[i] = stored[:1].decode()
                    break
                k += 1
        return found


def host_and_path(url: str | None) -> tuple[str, str]:
    """What follows the first ``://``, cut at ``?`` or ``#``, split at its first ``/``; both empty without one."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def judged(index: RuleIndex, hosts: list[str], paths: list[str], default: str, key=_key) -> tuple[list, list]:
    """The longest rule (host and path together; of equal length the longer host) of each url, and the verdict."""
    probes, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        labels = host.split(".")
        for s in range(len(labels)) if host else ():
            suffix = ".".join(labels[s:])
            for n in index.lengths:
                if n <= len(path):
                    probes.append((suffix, path[:n]))
                    owner.append(i)
    strings = [h + p for h, p in probes]
    unique = list(dict.fromkeys(strings))
    verdicts = dict(zip(unique, index.find(unique, key)))
    rule: list = [None] * len(hosts)
    verdict: list = [default] * len(hosts)
    best: list = [(-1, -1)] * len(hosts)
    for i, (h, _), s in zip(owner, probes, strings):
        if (v := verdicts[s]) and (len(s), len(h)) > best[i]:
            best[i], rule[i], verdict[i] = (len(s), len(h)), s, "allow" if v == "+" else "block"
    return rule, verdict


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; no rule gives a
    null rule and ``default``. Null and malformed urls have empty host and path, and no rule fits those. Hosts are
    lower-cased in ASCII only. There is no shuffle; extra columns are left behind; an empty table gives no rows.
    """
    spark = pages.sparkSession
    work = work_dir(spark, "rules")
    path = f"{work}/{work.rsplit('/', 1)[1]}.bin"
    write_bytes(spark, path, bytes(RuleIndex.build(rules)))
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RuleIndex.load(SparkFiles.get(name))
        for batch in batches:
            split = [host_and_path(u) for u in batch["url"]]
            hosts, paths = [h for h, _ in split], [p for _, p in split]
            rule, verdict = judged(index, hosts, paths, default)
            yield pd.DataFrame({"page_id": batch["page_id"], "host": hosts, "path": paths, "rule": pd.Series(rule, dtype=object), "verdict": verdict})

    ids = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    return source.mapInPandas(lean("url_filter", run), f"page_id {ids}, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM u
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, arg_max(h || p, (length(h || p), length(h))) AS rule, arg_max(v, (length(h || p), length(h))) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (page_id)
"""
