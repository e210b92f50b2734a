"""Merkle manifest of a table: a tree of digests for each group of rows, a tree over the groups, and proofs of rows.

Rows of a group are its leaves, in order. While a level has several nodes, every ``fanout`` consecutive ones become one
node, the digest of their digests; the last run of a level may be shorter (even one node) and is not padded.

1. Leaves are dealt into slices by ranges of (group, order), however many rows a group has, and numbered: a slice knows
   how many rows of its first group lie in slices before it.
2. Each task runs over its leaves with a mountain-range stack: a counter to base ``fanout`` whose carries close full runs.
   It tells every node that it makes, and what is left in its stack (nodes of runs that begin or end elsewhere).
3. These edges are merged by blocks of leaves, in rounds of ever larger blocks. There the size of the group is known,
   so short last runs close too, up to the roots. The roots of groups are the leaves of the tree over them.
4. Proofs go from the roots downwards, ``TIER`` levels at a time: each block of ``fanout ** TIER`` nodes gets one row with
   the path above it and works out the rest from its own nodes.

A task holds one block of nodes, or the edges of one block. Nothing is collected but the size of the largest group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import lean, small_batches, work_dir, written

#: Levels of a block of a proof; rows of a slice at most, on average; slices whose edges meet in a block at first, and
#: levels by which the blocks of each further round grow.
TIER, SLICE_ROWS, SLICES_MERGED, ROUND_LEVELS = 6, 1 << 20, 16, 8
_NODES = "g string, level int, idx long, digest string, total long, state string"
_NODE_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """A text for each group, null included, that keeps the order: null first, then bytewise."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def _told(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_NODE_NAMES = [c.split()[0] for c in _NODES.split(", ")]


class Stack:
    """The mountain range over leaves that come in order: for each level the open run, told as soon as it is full."""

    def __init__(self, fanout: int):
        self.fanout, self.open, self.out, self.at = fanout, {}, [], None

    def _left(self, level: int) -> None:
        """What is open at a level is told as edges."""
        first, digests = self.open.pop(level)
        self.out += [(self.at[0], level, first + i, d, None, "edge") for i, d in enumerate(digests)]

    def end(self) -> None:
        """The leaves to come do not follow the last one."""
        for level in list(self.open):
            self._left(level)

    def push(self, g: str, idx: int, d: str) -> None:
        if self.at != (g, idx):
            self.end()
        self.at, level = (g, idx + 1), 0
        while True:
            self.open.setdefault(level, (idx, []))[1].append(d)
            if (idx + 1) % self.fanout:
                return
            if len(self.open[level][1]) < self.fanout:  # the run began before these leaves
                return self._left(level)
            d, level, idx = digest(*self.open.pop(level)[1]), level + 1, idx // self.fanout
            self.out.append((g, level, idx, d, None, "node"))


def _stacked(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(fanout)
        for batch in batches:
            for g, idx, d in zip(*(batch.column(c).to_pylist() for c in range(3))):
                stack.push(g, idx, d)
            yield _told(stack.out, _NODE_TYPES, _NODE_NAMES)
            stack.out = []
        stack.end()
        yield _told(stack.out, _NODE_TYPES, _NODE_NAMES)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that share their first ``keys`` columns, of batches in that order."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key and held:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row)
    if held:
        yield key, held


def merge_edges(g: str, total: int, edges: list[tuple[int, int, str]], fanout: int) -> list[tuple]:
    """Nodes that the ``(level, idx, digest)`` of a group of ``total`` leaves make, short last runs included; what stays
    open, as edges again; the root."""
    levels: dict[int, dict[int, str]] = {}
    for level, idx, d in edges:
        levels.setdefault(level, {})[idx] = d
    out, level = [], min(levels, default=0)
    while levels:
        here, size = levels.pop(level, {}), -(-total // fanout**level)
        runs: dict[int, list[tuple[int, str]]] = {}
        for idx in sorted(here):
            runs.setdefault(idx // fanout, []).append((idx, here[idx]))
        for run, members in runs.items():
            if size == 1:
                out.append((g, level, 0, members[0][1], total, "root"))
            elif len(members) == min(fanout, size - run * fanout):
                d = digest(*(m for _, m in members))
                levels.setdefault(level + 1, {})[run] = d
                out.append((g, level + 1, run, d, total, "node"))
            else:
                out += [(g, level, idx, d, total, "edge") for idx, d in members]
        level += 1
    return out


def _merged(fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (g, total, _), rows in _groups(batches, 3):
            out += merge_edges(g, total, [r[3:] for r in rows], fanout)
            if len(out) > 4096:
                yield _told(out, _NODE_TYPES, _NODE_NAMES)
                out = []
        yield _told(out, _NODE_TYPES, _NODE_NAMES)

    return run


def _power(fanout: int, least: int) -> int:
    """The smallest k for which ``fanout ** k`` is at least ``least``."""
    k = 0
    while fanout**k < least:
        k += 1
    return k


@dataclass
class Trees:
    """The trees of all groups: ``rows`` (``g, idx, leaf`` and what came with the leaves), ``nodes`` above the leaves
    (``g, level, idx, digest, total``), ``roots`` (``g, level, digest, total``), and the size of the largest group."""

    rows: DataFrame
    nodes: DataFrame
    roots: DataFrame
    largest: int
    fanout: int


def trees(leaves: DataFrame, order: list[str], work: str, fanout: int = 3) -> Trees:
    """Trees of ``leaves``: ``g`` (text), the columns of ``order``, ``leaf`` and others. Leaves of a group ascend by
    ``order`` (nulls first), then by digest, so rows that are alike in all of these may take each other's place. The
    names ``k``, ``idx``, ``slice``, ``base`` and ``tie`` are taken."""
    spark = leaves.sparkSession
    small_batches(spark)
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), f"{work}/leaves")
    count, n = leaves.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, -(-count // SLICE_ROWS))
    keys = ["g", *order, "leaf", "tie"]
    dealt = leaves.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("slice", F.spark_partition_id()).drop("tie")
    at = dealt.columns.index("g")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for batch in batches:
            places = []
            for g in batch.column(at).to_pylist():
                now, k = (g, k + 1) if g == now else (g, 0)
                places.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "k"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", k long"
    dealt = written(dealt.mapInArrow(lean("merkle", numbered), schema), f"{work}/slices")
    counts = dealt.groupBy("slice", "g").agg((F.max("k") + 1).alias("n"))
    earlier = W.partitionBy("g").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    based = written(counts.select("slice", "g", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), f"{work}/bases")
    totals = based.groupBy("g").agg(F.sum("n").alias("total"))
    # Only the first group of a slice can have rows in an earlier one: a row for each slice at most.
    rows = dealt.join(F.broadcast(based.where("base > 0").drop("n")), ["slice", "g"], "left")
    rows = rows.withColumn("idx", F.col("k") + F.coalesce("base", F.lit(0))).drop("slice", "k", "base")
    largest = totals.agg(F.max("total")).first()[0] or 0

    stack = written(rows.select("g", "idx", "leaf").mapInArrow(lean("merkle", _stacked(fanout)), _NODES), f"{work}/stack")
    told, rounds = [stack.where("state = 'node'")], 0
    edges = stack.where("state = 'edge'").drop("total").join(totals, "g")
    exponent = _power(fanout, max(1, SLICES_MERGED * (count // n)))
    while largest:
        whole = fanout**exponent >= largest
        width = F.pow(F.lit(float(fanout)), F.col("level")).cast("long")
        block = F.lit(0).cast("long") if whole else F.floor(F.col("idx") * width / F.lit(float(fanout**exponent))).cast("long")
        sent = edges.select("g", "total", block.alias("block"), "level", "idx", "digest")
        sent = sent.repartition(n, "g", "block").sortWithinPartitions("g", "block", "level", "idx")
        done = written(sent.mapInArrow(lean("merkle", _merged(fanout)), _NODES), f"{work}/round{rounds}")
        told.append(done.where("state <> 'edge'"))
        if whole:
            break
        edges, exponent, rounds = done.where("state = 'edge'"), exponent + ROUND_LEVELS, rounds + 1
    every = reduce(DataFrame.unionByName, told)
    nodes = every.where("state = 'node'").drop("state", "total")
    roots = every.where("state = 'root'").drop("state", "idx")
    return Trees(rows, nodes, roots, largest, fanout)


def pack(path: list[tuple[str, str]]) -> str:
    """A path as text: for each level the digests to the left and to the right."""
    return "/".join(f"{a},{b}" for a, b in path)


def unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(p.split(",")) for p in path.split("/")] if path else []


def block_paths(digests: list[str], level: int, total: int, fanout: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each node of an aligned block of a level: what stands beside it in its run, and beside its ancestors up to
    ``levels`` levels higher or the root."""
    sides, here = [], digests
    for k in range(level, level + levels):
        if -(-total // fanout**k) == 1:
            break
        runs = [here[a : a + fanout] for a in range(0, len(here), fanout)]
        sides.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
        here = [digest(*run) for run in runs]
    return [[s[i // fanout**k] for k, s in enumerate(sides)] for i in range(len(digests))]


#: What a block is told: group, leaves of the group, path above it, root of the group and of all.
_ABOVE = ["g", "total", "path", "subroot", "root"]


def proofs(
    trees: Trees,
    above: DataFrame,
    work: str,
    carried: list[str],
    schema: str,
    tell: Callable[[tuple, list[tuple[str, str]], str, str], tuple],
) -> DataFrame:
    """One row of ``schema`` for each leaf: ``tell(values of leaf and carried columns, path, subroot, root)``.

    ``above``: ``g, total, path, subroot, root``, what stands above the root of each group (``path`` is packed).
    """
    fanout, levels = trees.fanout, TIER
    width = fanout**levels
    spark = above.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiers = _power(fanout, trees.largest) // levels + 1
    types = {f.name: f.dataType for f in trees.rows.schema}
    types_of = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names, kinds = zip(*((name, types_of[kind]) for name, kind in map(str.split, schema.split(", "))))
    context = None

    def runner(tier: int, carry: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for (g, block), rows in _groups(batches, 2):
                _, _, idx, total, path, subroot, root = rows[0][:7]
                if idx != -1 or len(rows) < 2 or rows[1][2] == -1:
                    raise ValueError(f"block {block} of tier {tier} of a group has no path or no nodes")
                up, nodes = unpack(path), rows[1:]
                for row, own in zip(nodes, block_paths([r[7] for r in nodes], tier * levels, total, fanout, levels)):
                    if tier:
                        out.append((g, row[2], total, pack(own + up), subroot, root))
                    else:
                        out.append(tell(row[7 : 8 + carry], own + up, subroot, root))
                if len(out) > 2048:
                    yield _told(out, told_types, told_names)
                    out = []
            yield _told(out, told_types, told_names)

        told_types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if tier else list(kinds)
        told_names = ["g", "block", *_ABOVE[1:]] if tier else list(names)
        return run

    for tier in reversed(range(tiers)):
        first = above.select("g", F.lit(0).cast("long").alias("block"), *_ABOVE[1:])
        # Groups whose roots lie in this tier, on its lowest level at least.
        low, high = F.col("total") > (fanout ** (tier * levels - 1) if tier else 0), F.col("total") <= fanout ** (tier * levels + levels - 1)
        first = first.where(low & high)
        context = first if context is None else first.unionByName(context)
        nodes = trees.nodes.where(F.col("level") == tier * levels).withColumnRenamed("digest", "leaf") if tier else trees.rows
        extra = [] if tier else carried
        empty = [F.lit(None).cast("string").alias(c) for c in ("path", "subroot", "root")]
        nodes = nodes.select("g", F.floor(F.col("idx") / width).cast("long").alias("block"), "idx", F.lit(None).cast("long").alias("total"), *empty, "leaf", *extra)
        heads = context.select("g", "block", F.lit(-1).cast("long").alias("idx"), "total", "path", "subroot", "root", F.lit(None).cast("string").alias("leaf"), *(F.lit(None).cast(types[c]).alias(c) for c in extra))
        sent = nodes.unionByName(heads).repartition(n, "g", "block").sortWithinPartitions("g", "block", "idx")
        kind = "g string, block long, total long, path string, subroot string, root string" if tier else schema
        context = sent.mapInArrow(lean("merkle", runner(tier, len(extra))), kind)
        if tier:
            context = written(context, f"{work}/tier{tier}")
    return context


def folded(d: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest gives with what its path has beside it."""
    for left, right in path:
        d = digest(left, d, right)
    return d


@dataclass
class Manifest:
    """``groups`` has the trees over rows, ``top`` the one over groups, ``above`` what stands above each group's root."""

    groups: Trees
    top: Trees
    above: DataFrame


def manifest(leaves: DataFrame, order: list[str], work: str, fanout: int = 3) -> Manifest:
    """Trees of ``leaves`` (``g, leaf``, the columns of ``order`` and others), and the tree over their roots by ``g``."""
    groups = trees(leaves, order, f"{work}/groups", fanout)
    over = groups.roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("digest").alias("leaf"), F.col("total").alias("size"))
    top = trees(over, ["key"], f"{work}/top", fanout)
    root = top.roots.select("g", "total", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    told = lambda row, path, subroot, root: (row[1], row[2], pack(path), row[0], root)
    above = proofs(top, root, f"{work}/above", ["key", "size"], "g string, total long, path string, subroot string, root string", told)
    return Manifest(groups, top, written(above, f"{work}/known"))


def proved_row(values: tuple, path: list[tuple[str, str]], subroot: str, root: str) -> tuple:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of a leaf that is now ``tampered``."""
    own, doc_id, tampered = values
    again = folded(tampered, path)
    return doc_id, own, subroot, root, digest(*(s for pair in path for s in pair)), again, again == root


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proved(before: DataFrame, tampered: Column, work: str, fanout: int = 3) -> DataFrame:
    """The manifest of ``before`` (rows ``doc_id, source, lang, n_chars, text``), a proof of each row against it, and
    whether the row with ``tampered`` instead of its text still gives the root.

    Nulls are values of their own, in any column; null ids come first. Rows that repeat an id and all other values are
    leaves of their own. An empty table gives no rows. Other columns are left behind.
    """
    columns = ["doc_id", "source", "lang", "n_chars"]
    rows = before.select(
        group_key(F.col("source")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(*map(F.col, columns), F.col("text")).alias("leaf"),
        leaf(*map(F.col, columns), tampered).alias("tampered"),
    )
    m = manifest(rows, ["doc_id"], work, fanout)
    return proofs(m.groups, m.above, f"{work}/proofs", ["doc_id", "tampered"], PROVED, proved_row)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return proved(docs, tampered, work_dir(spark, "merkle"))


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


#: Levels are a recursive query over runs of three; paths are joins of each row's ancestors with the rest of their runs.
OP11_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], CAST(range(8) AS BIGINT[])),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT *, coalesce('=' || source, '') AS g, CAST(doc_id AS VARCHAR) AS s FROM documents
), c AS (
  SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, CAST(strlen(s) AS BIGINT) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
      lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) % 2 = 0 AS hit
  FROM d, bits
), h AS (
  SELECT doc_id, g, {_leaf_sql("text")} AS leaf, {_leaf_sql("(CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END)")} AS tampered FROM c
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM h
), nodes AS (
  SELECT g, 0 AS lvl, idx, n, leaf AS x FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY g, lvl, n, idx // 3
), subroots AS (
  SELECT g, x AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, idx, n, subroot AS x FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, n, idx // 3
), steps AS (
  SELECT l.g, l.idx, a.lvl, coalesce(string_agg(b.x, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.x, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS behind
  FROM leaves l JOIN nodes a ON a.g = l.g AND a.n > 1 AND a.idx = l.idx // CAST(pow(3, a.lvl) AS BIGINT)
  JOIN nodes b ON b.g = a.g AND b.lvl = a.lvl AND b.idx // 3 = a.idx // 3
  GROUP BY l.g, l.idx, a.lvl, a.idx
  UNION ALL
  SELECT l.g, l.idx, 1000 + a.lvl, coalesce(string_agg(b.x, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''),
    coalesce(string_agg(b.x, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM leaves l JOIN subroots s ON s.g = l.g JOIN tops a ON a.n > 1 AND a.idx = s.idx // CAST(pow(3, a.lvl) AS BIGINT)
  JOIN tops b ON b.lvl = a.lvl AND b.idx // 3 = a.idx // 3
  GROUP BY l.g, l.idx, a.lvl, a.idx
), paths AS (
  SELECT g, idx, list(before ORDER BY lvl) AS lefts, list(behind ORDER BY lvl) AS rights, string_agg(before || behind, '' ORDER BY lvl) AS sides
  FROM steps GROUP BY g, idx
), folds AS (
  SELECT l.g, l.idx, 0 AS k, coalesce(len(lefts), 0) AS m, tampered AS x FROM leaves l LEFT JOIN paths p ON p.g = l.g AND p.idx = l.idx
  UNION ALL
  SELECT f.g, f.idx, k + 1, m, sha256(lefts[k + 1] || x || rights[k + 1]) FROM folds f JOIN paths p ON p.g = f.g AND p.idx = f.idx WHERE k < m
)
SELECT doc_id, leaf, subroot, t.x AS root, sha256(coalesce(sides, '')) AS proof_sha256, f.x AS folded_root, f.x = t.x AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN tops t ON t.n = 1
LEFT JOIN paths p ON p.g = l.g AND p.idx = l.idx JOIN folds f ON f.g = l.g AND f.idx = l.idx AND f.k = f.m
"""
