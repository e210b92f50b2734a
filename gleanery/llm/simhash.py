"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes over word shingles. Equal fingerprints are one class. Classes within ``bits``
differing bits are found in an index whose upper nodes are masked bit patterns: the 64 bits are cut into ``bits`` +
``shared`` blocks, and two fingerprints that differ in ``bits`` bits at most agree in ``shared`` blocks at least, so
each fingerprint is filed under every choice of ``shared`` blocks (for 2 bits and 2 shared: four blocks of 16, six
patterns of 32 bits). More shared blocks mean longer patterns with fewer members each, for larger tables. Patterns are
dealt out over the cluster; a pair that shares several is found under the first. Within a task, entries of a pattern are sorted by Gray rank, in which fingerprints with the
same upper bits are neighbours; runs that share the upper third of the free bits form nodes of the first level, those
that share two thirds nodes of the second, below which are the leaves. The search goes down pairs of nodes and adds up
differing bits: two nodes whose sum exceeds ``bits`` drop all pairs of their members at once.

A task reports a spanning forest of the links it finds, never all pairs, so a large group of near copies gives as many
rows as it has members. Patterns with very many members are first filed again under parts of their remaining bits. A
task goes through its patterns in order and holds a few of them at a time.

``near_groups`` uses the same index for near duplicates by five-word shingles; see there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import listed, lean, row_bits, small_batches, work_dir, written
from gleanery.llm.components import components

SEED = 42
#: Shingles hashed at once, and members of a pattern above which it is filed again under longer patterns.
BLOCK, CROWD = 1 << 16, 4096
#: Index entries that a task holds at least before it searches them, and pairs of nodes that it judges at once.
HELD, PAIRS = 1 << 15, 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text: A-Z lower-cased, words between ASCII white space, repeats of shingles counted; no words:
    zero."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    n = max(1, len(ws) - words + 1)
    runs = map(b" ".join, zip(*(ws[i : i + n] for i in range(words)))) if len(ws) >= words else iter([b" ".join(ws)])
    hashes = map(xxhash.xxh64_intdigest, runs, repeat(SEED))
    ones = np.zeros(64, "i8")
    for a in range(0, n, BLOCK):
        block = np.fromiter(hashes, ">u8", min(BLOCK, n - a))
        ones += np.unpackbits(block.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Columns ``id, fp`` (the fingerprint as a signed 64-bit integer), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("i8"))], ["id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(lean("simhash", run), f"id {source.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a code word in the reflected Gray sequence."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int) -> list[int]:
    """Masks of blocks that cut the 64 bits as evenly as possible."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def free_parts(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, cut into ``parts`` masks, lowest bits first."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]


def choices(bits: int, shared: int) -> list[int]:
    """The masks that fingerprints are filed under: every choice of ``shared`` blocks."""
    return [sum(c) for c in combinations(block_masks(bits + shared), shared)]


def filed(classes: DataFrame, bits: int, shared: int, work: str, prints: tuple[str, ...] = ("fp",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Index entries ``place, mask, pattern, fp`` and ``carry``: each fingerprint (columns ``prints``, each an index of
    its own) under each choice of blocks, crowded patterns refined."""
    masks = choices(bits, shared)
    array = lambda values: F.array(*(F.lit(signed(m)) for m in values))
    pattern = F.col("fp").bitwiseAND(F.col("mask")).alias("pattern")
    tables = classes.select(F.posexplode(F.array(*prints)).alias("place", "fp"), *carry)
    entries = tables.select("place", "fp", F.explode(array(masks)).alias("mask"), *carry).select("place", "mask", pattern, "fp", *carry)
    keys = ["place", "mask", "pattern"]
    crowded = written(entries.groupBy(*keys).count().where(F.col("count") > CROWD).drop("count"), f"{work}/crowded")
    if not crowded.count():
        return entries
    rest = entries.join(crowded, keys, "left_anti")
    longer = F.create_map(*(x for m in masks for x in (F.lit(signed(m)), array(m | t for t in free_parts(m, bits + 1)))))
    finer = entries.join(crowded, keys).select("place", "fp", F.explode(F.element_at(longer, F.col("mask"))).alias("mask"), *carry)
    return rest.unionByName(finer.select("place", "mask", pattern, "fp", *carry))


def foremost(masks: list[int], bits: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of a pair that agrees under several masks, whether this is the first one: each pair is found once in an index.

    Takes masks of entries and differences of pairs. A refined mask is first if its choice of blocks is and, of its
    parts, the part that it adds."""
    parts = {m: free_parts(m, bits + 1) for m in masks}
    order = [(m, m) for m in masks] + [(m | t, m) for m in masks for t in parts[m]]

    def first(mask: np.ndarray, apart: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask), "?")
        for m, base in order:
            at = np.flatnonzero(mask == np.uint64(m))
            if len(at):
                earlier = list(masks[: masks.index(base)])
                if m != base:
                    earlier += [base | t for t in parts[base][: parts[base].index(m ^ base)]]
                out[at] = ~np.logical_or.reduce([apart[at] & np.uint64(e) == 0 for e in earlier] or [np.zeros(len(at), "?")])
        return out

    return first


def _children(heads: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes that begin at places ``heads``: the first of the nodes ``below`` in each, and their number."""
    first = np.searchsorted(below, heads)
    return first, np.diff(np.r_[first, len(below)])


def _pairs_below(
    a: np.ndarray,
    b: np.ndarray,
    d: np.ndarray,
    first: np.ndarray,
    count: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of children of the pairs ``a, b`` with the differences ``d`` so far, a bounded number at a time; of a
    node and itself each pair once, a child and itself included."""
    ends = np.cumsum(count[a] * count[b])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        flat = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
        of = np.searchsorted(ends, flat, "right")
        i, j = np.divmod(flat - (ends[of] - count[a[of]] * count[b[of]]), count[b[of]])
        once = (a[of] != b[of]) | (i <= j)
        of, i, j = of[once], i[once], j[once]
        yield first[a[of]] + i, first[b[of]] + j, d[of]


def linked(
    mask: np.ndarray,
    pattern: np.ndarray,
    fp: np.ndarray,
    bits: int,
    accept: Callable | None = None,
    place: np.ndarray | None = None,
    first: Callable | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within ``bits`` differing bits under the same pattern that ``first`` and ``accept`` accept: two arrays
    of places."""
    if not len(fp):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    place = np.zeros(len(fp), "i8") if place is None else place
    order = np.lexsort((gray_rank(fp), pattern, mask, place))
    place, mask, pattern, fp = place[order], mask[order], pattern[order], fp[order]
    parts = np.zeros((3, len(fp)), "u8")
    for m in np.unique(mask):
        parts[:, mask == m] = np.array(free_parts(int(m), 3)[::-1], "u8")[:, None]
    fresh = np.r_[True, (place[1:] != place[:-1]) | (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]
    levels = [np.flatnonzero(fresh)]
    for k in range(2):
        upper = fp & parts[k]
        fresh = fresh | np.r_[True, upper[1:] != upper[:-1]]
        levels.append(np.flatnonzero(fresh))
    levels.append(np.arange(len(fp)))
    below = [_children(levels[k], levels[k + 1]) for k in range(3)]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def down(level: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        for i, j, so_far in _pairs_below(a, b, d, *below[level]):
            x, y = levels[level + 1][i], levels[level + 1][j]
            so_far = so_far + np.bitwise_count((fp[x] ^ fp[y]) & parts[level][x])
            near = so_far <= bits
            if level < 2:
                down(level + 1, i[near], j[near], so_far[near])
                continue
            near &= i < j
            x, y = x[near], y[near]
            if first is not None:
                own = first(mask[x], fp[x] ^ fp[y])
                x, y = x[own], y[own]
            x, y = order[x], order[y]
            if accept is not None:
                ok = accept(x, y)
                x, y = x[ok], y[ok]
            if len(x):
                found.append((x, y))

    tops = np.arange(len(levels[0]))
    many = np.diff(np.r_[levels[0], len(fp)]) > 1
    down(0, tops[many], tops[many], np.zeros(int(many.sum()), "i8"))
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Forest:
    """Union-find over 64-bit values; remembers only values that were joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def by_pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of entries that come in the order of patterns, put together to whole patterns."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < HELD:
            continue
        all_ = pa.concat_batches(held)
        keys = [np.asarray(all_.column(k)) for k in range(3)]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield all_.slice(0, cut)
        held, rows = [all_.slice(cut)], all_.num_rows - cut
    if rows:
        yield pa.concat_batches(held)


def stars(forest: Forest) -> pa.RecordBatch:
    """Each value that was joined with the smallest one that it reaches."""
    pairs = [(x, y) for x in list(forest.up) if (y := forest.find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer steps to follow: what each partition of ``a, b`` joins, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(x, y)
        yield stars(forest)

    return edges.select("a", "b").mapInArrow(lean("simhash", run), "a long, b long")


def searched(entries: DataFrame, bits: int, shared: int, key: str, accept: Callable | None = None, whole: bool = False) -> DataFrame:
    """Pairs ``a, b`` of values of ``key`` whose entries are linked and accepted: for each task a spanning forest of
    them, or ``whole``, all of them. ``accept`` makes of a batch of entries a test of pairs of places. Without it links
    need no proof, and a task reports each value with the smallest that it reaches, so no chains are left to follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, first = Forest(), foremost(choices(bits, shared), bits)
        for batch in by_pattern(batches):
            place = np.asarray(batch.column(0)).astype("i8")
            mask, pattern, fp = (np.asarray(batch.column(k)).view("u8") for k in (1, 2, 3))
            name = np.asarray(batch.column(batch.schema.get_field_index(key)))
            a, b = linked(mask, pattern, fp, bits, accept and accept(batch), place, first)
            pairs = np.unique(np.sort(np.stack([name[a], name[b]], axis=1), axis=1), axis=0)
            if not whole:
                pairs = pairs[[forest.join(x, y) for x, y in pairs.tolist()]] if len(pairs) else pairs
            if accept is None:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy(), pa.int64()) for k in (0, 1)], ["a", "b"])

        if accept is None:
            yield stars(forest)

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["place", "mask", "pattern"]
    return entries.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(lean("simhash", run), "a long, b long")


def links(classes: DataFrame, bits: int, work: str, shared: int = 2) -> DataFrame:
    """Edges ``a, b`` between fingerprints within ``bits`` bits: per task a spanning forest of what it found."""
    return searched(filed(classes.select("fp"), bits, shared, work), bits, shared, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2, shared: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Null and empty texts have fingerprint zero and are linked like any other. ``component_id`` is the smallest id that
    is reachable over links, the row's own included; null ids are passed over (null if a component has no other).
    Repeated rows each give a row. An empty table gives no rows; extra columns are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = work_dir(spark, "simhash")
    prints = written(fingerprints(docs, id_col, text_col, words), f"{work}/prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), f"{work}/classes")
    roots = components(links(classes, bits, work, shared), work)
    joined = written(classes.join(roots, classes.fp == roots.node).select("fp", "root", "least"), f"{work}/joined")
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked_classes = joined.join(best, "root").select("fp", F.col("component_id").alias("reached"))
    final = written(classes.join(linked_classes, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")), f"{work}/final")
    return prints.join(final, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: One word of 64 bits for each stream of hashes, and the multipliers of the 64-bit finaliser that mixes them (fixed values).
_STREAM, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Odd factors by which the hashes of the words of a shingle are added up.
_FACTORS = [xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(64)]
#: Sketch of a document in the index: shingles, two SimHashes over them, parities of 256 classes of them.
SKETCH = np.dtype([("size", "<i4"), ("g", "<u8", 2), ("q", "<u8", 4)])
#: Bits of the two SimHashes over shingles that may differ: at a similarity of 0.8 they differ in 19.4 of 128 on
#: average, with a deviation of 4.1; unrelated texts differ in 64.
APART = 36


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_rows(ids: np.ndarray, words: int) -> np.ndarray:
    """The distinct runs of ``words`` word numbers, each as one value; a shorter text is one run, padded."""
    if not len(ids):
        return np.zeros(0, f"V{4 * words}")
    if len(ids) < words:
        ids = np.r_[ids, np.full(words - len(ids), 0xFFFFFFFF, "u4")]
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids.astype("u4"), words))
    return np.unique(rows.view(f"V{4 * words}").ravel())


def similar(a: str | None, b: str | None, words: int = 5, share: tuple[int, int] = (4, 5)) -> bool:
    """Whether the Jaccard similarity of the sets of ``words``-word shingles is ``share`` at least, by the words
    themselves, numbered as they come; two texts without words are alike."""
    numbers: dict[bytes, int] = {}
    x, y = (shingle_rows(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(t)), "u4"), words) for t in (a, b))
    if share[1] * min(len(x), len(y)) < share[0] * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return share[1] * both >= share[0] * (len(x) + len(y) - both)


def mixed(h: np.ndarray, stream: int) -> np.ndarray:
    """Independent hashes of hashes, by a 64-bit finaliser."""
    h = h + np.uint64(stream * _STREAM & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX_2)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray, stream: int) -> int:
    """The SimHash of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, "i8")
    for a in range(0, len(h), BLOCK):
        ones += np.unpackbits(mixed(h[a : a + BLOCK], stream).astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def sketch(text: str | None, words: int, tables: int) -> tuple[list[int], bytes]:
    """``tables`` SimHashes over words, repeats included, and the sketch of the set of shingles."""
    ws = words_of(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws, repeat(SEED)), "u8", len(ws))
    n = min(words, len(ws))
    runs = np.zeros(len(ws) - n + 1 if n else 0, "u8")
    for k in range(n):
        runs += h[k : k + len(runs)] * np.uint64(_FACTORS[k])
    runs = np.unique(runs)
    out = np.zeros(1, SKETCH)
    out["size"] = len(runs)
    out["g"] = [majority(runs, tables + k) for k in range(2)]
    out["q"] = np.packbits(np.bincount((mixed(runs, tables + 2) >> np.uint64(56)).astype("i8"), minlength=256) & 1).view("<u8")
    return [majority(h, k) for k in range(tables)], out.tobytes()


def sketches(rows: DataFrame, words: int, tables: int) -> DataFrame:
    """``doc_id, file, row, sketch, f0, f1...`` of rows ``doc_id, file, row, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sketch(t.as_py(), words, tables) for t in batch.column(3)]
            prints = np.array([g[0] for g in got], "u8").reshape(-1, tables)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([g[1] for g in got], pa.binary()), *(pa.array(prints[:, k].copy().view("i8")) for k in range(tables))],
                names,
            )

    names = ["doc_id", "file", "row", "sketch", *(f"f{k}" for k in range(tables))]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "file", "row", "text").mapInArrow(
        lean("simhash", run),
        f"doc_id {kind}, file string, row long, sketch binary" + "".join(f", f{k} long" for k in range(tables)),
    )


def may_be_similar(share: tuple[int, int]) -> Callable:
    """For ``searched``: whether sketches allow the similarity. Sizes and parities never rule out a similar pair: two
    sets differ in as many shingles as parities at least."""

    def of(batch: pa.RecordBatch) -> Callable:
        marks = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sketch")).to_pylist()), SKETCH)
        root = np.asarray(batch.column(batch.schema.get_field_index("root")))

        def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = np.flatnonzero(root[x] != root[y])
            a, b = marks[x[ok]], marks[y[ok]]
            least, most = np.minimum(a["size"], b["size"]).astype("i8"), np.maximum(a["size"], b["size"])
            odd = np.bitwise_count(a["q"] ^ b["q"]).sum(axis=1, dtype="i8")
            far = np.bitwise_count(a["g"] ^ b["g"]).sum(axis=1, dtype="i8")
            out = np.zeros(len(x), "?")
            out[ok] = (least * share[1] >= most * share[0]) & (odd * (share[0] + share[1]) <= (least + most) * (share[1] - share[0])) & (far <= APART)
            return out

        return accept

    return of


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose texts (``n, text``) are similar, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), words, share) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    side = lambda k: texts.select(F.col("n").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lean("simhash", run), "a long, b long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    share: tuple[int, int] = (4, 5),
    bits: int = 3,
    tables: int = 3,
    shared: int = 2,
) -> DataFrame:
    """Near duplicates by sets of word shingles: ``doc_id, file, row, n, root`` for each row of ``docs``, which come
    straight from files, that is linked to another one; ``n`` numbers the rows, ``root`` is the smallest ``n`` reached.

    Candidates are rows of which one of ``tables`` SimHashes over words lies within ``bits`` bits and whose sketches
    allow the similarity ``share``; the Gray-order index finds them. A link is a candidate pair whose sets of
    ``words``-word shingles have that Jaccard similarity, counted on the words of both texts, so no link is false.
    SimHash misses some pairs near the threshold: the README has the recall. Rows of equal sketches are held against
    one of them. Then each task reports a spanning forest of its candidates, all of which are confirmed or refuted; a
    second search over the rows of these reports each candidate pair that is not in one component yet. What it leaves
    out changes no component.

    Null and empty texts have no words and are alike. Shorter texts than ``words`` are one shingle. Repeated rows and
    null ids are rows like others. An empty table gives no rows; other columns are left behind.
    """
    small_batches(docs.sparkSession)
    work = work_dir(docs.sparkSession, "near")
    source = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    # One row for each file; 2^40 rows of each. Only rows without their texts, and listed ones, meet these numbers.
    names = written(source.select("file").distinct(), f"{work}/names")
    numbers = written(names.select("file", F.row_number().over(Window.orderBy("file")).cast("long").alias("f")), f"{work}/files")
    n = (F.shiftleft("f", 40) + F.col("row")).alias("n")

    prints = tuple(f"f{k}" for k in range(tables))
    marks = written(sketches(source, words, tables).join(numbers, "file").select("doc_id", "file", "row", n, "sketch", *prints), f"{work}/marks")
    counted = written(marks.groupBy("sketch", *prints).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("many")), f"{work}/classes")
    classes = counted.drop("many")
    same = marks.join(
        counted.where("many > 1").select("sketch", *prints, F.col("n").alias("a")),
        ["sketch", *prints],
    ).where("n <> a").select("a", F.col("n").alias("b"))

    def search(some: DataFrame, whole: bool, name: str) -> DataFrame:
        entries = filed(some, bits, shared, f"{work}/{name}", prints, ("n", "root", "sketch"))
        return searched(entries, bits, shared, "n", may_be_similar(share), whole).distinct()

    first = written(search(classes.withColumn("root", F.col("n")), False, "first").unionByName(same).distinct(), f"{work}/first-pairs")
    ends = written(first.select(F.col("a").alias("n")).union(first.select("b")).distinct(), f"{work}/ends")
    places = ends.select(F.shiftright("n", 40).alias("f"), F.col("n").bitwiseAND(F.lit((1 << 40) - 1)).alias("row")).join(numbers, "f")
    found = written(row_bits(places), f"{work}/found")
    texts = written(listed(source.select("file", "row", "text"), found).join(numbers, "file").select(n, "text"), f"{work}/texts")
    edges = written(confirmed(first, texts, words, share), f"{work}/links")
    roots = components(contracted(edges), f"{work}/once")

    rooted = classes.join(ends, "n", "left_semi").join(roots, F.col("n") == F.col("node"), "left").select(
        *classes.columns,
        F.coalesce("root", "n").alias("root"),
    )
    second = search(written(rooted, f"{work}/rooted"), True, "second")
    second = written(second.join(first, ["a", "b"], "left_anti"), f"{work}/second-pairs")
    more = written(confirmed(second, texts, words, share), f"{work}/more-links")
    if more.count():
        roots = components(contracted(edges.unionByName(more)), f"{work}/twice")
    return marks.select("doc_id", "file", "row", "n").join(roots, F.col("n") == F.col("node")).select("doc_id", "file", "row", "n", "root")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
