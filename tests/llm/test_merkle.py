import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleanery.llm import merkle
from gleanery.llm.common import work_dir

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][a : a + fanout]) for a in range(0, len(out[-1]), fanout)])
    return out


def path(tree, i, fanout):
    out = []
    for level in tree[:-1]:
        a = i // fanout * fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return out


def plain(rows, fanout=3):
    """All result rows by whole lists."""
    groups = {}
    for doc_id, source, lang, n_chars, text, *_ in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        now = text.replace("\n", "") if hit and text is not None else text
        own, changed = (leaf_of(doc_id, source, lang, n_chars, t) for t in (text, now))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, changed, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[2] for r in sorted(groups[s])], fanout) for s in order}
    top = levels([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, changed, doc_id) in enumerate(sorted(groups[s])):
            sides = path(trees[s], i, fanout) + path(top, k, fanout)
            again = changed
            for a, b in sides:
                again = h(a, again, b)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in sides)), again, again == top[-1][0]))
    return sorted(out, key=str)


def proved(spark, rows, fanout=3, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    now = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.proved(docs, now, work_dir(spark, "merkle-test"), fanout).collect()), key=str)


def table(n, seed):
    rng = random.Random(seed)
    rows = [(i * 7 % 5003, rng.choice(["hot"] * 6 + [f"s{k}" for k in range(12)] + ["é", "", None]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "a\nb", f"t {i}\n\nü"]), 1, "x") for i in range(n)]
    alike = (None, "hot", None, None, "same\n", 1, "x")
    return rows + [alike] * 40 + [(3, "hot", "en", 1, f"tie {k}", 1, "x") for k in range(5)] + [(4, "long", "en", 1, "w\n" * 600_000, 1, "x")]


def test_whole_table_against_lists(spark):
    rows = table(700, 2)
    got, want = proved(spark, rows, 2), plain(rows, 2)
    assert got == want and len({r[3] for r in got}) == 1
    assert {r[6] for r in got} == {True, False}


def test_many_rounds_and_tiers(spark, monkeypatch):
    """Blocks so small that edges need several merging rounds and proofs several tiers."""
    for name, value in {"TIER": 2, "SLICE_ROWS": 40, "SLICES_MERGED": 1, "ROUND_LEVELS": 1}.items():
        monkeypatch.setattr(merkle, name, value)
    rows = table(600, 9)
    assert proved(spark, rows) == plain(rows)


def test_small_groups_and_lone_ones(spark):
    rows = [(i, f"s{n}", "en", 1, "a\nb", 1, "x") for n in (1, 2, 3, 4, 9, 10, 28) for i in range(n)]
    assert proved(spark, rows) == plain(rows)
    assert proved(spark, rows[:1]) == plain(rows[:1])
    assert proved(spark, []) == []


def test_stack_tells_each_full_run_once():
    """Any cut of the leaves into tasks gives the tree's nodes, each once, after merging."""
    rng = random.Random(1)
    for n in (1, 5, 26, 27, 28, 200):
        digests = [h(str(i)) for i in range(n)]
        tree, cuts = levels(digests, 3), sorted({0, n, *rng.choices(range(n), k=4)})
        told = []
        for a, b in zip(cuts, cuts[1:]):
            stack = merkle.Stack(3)
            for i in range(a, b):
                stack.push("g", i, digests[i])
            stack.end()
            told += stack.out
        edges = [(r[1], r[2], r[3]) for r in told if r[5] == "edge"]
        told = [r for r in told if r[5] == "node"] + merkle.merge_edges("g", n, edges, 3)
        nodes = [(r[1], r[2], r[3]) for r in told if r[5] == "node"]
        assert len(nodes) == len(set(nodes))
        assert set(nodes) == {(k, i, d) for k, level in enumerate(tree) if k for i, d in enumerate(level)}
        assert [r[3] for r in told if r[5] == "root"] == tree[-1] and not [r for r in told[len(told) - 1 :] if r[5] == "edge"]


def test_a_block_without_its_path_is_an_error(spark):
    leaves = spark.createDataFrame([("a", 1, h("x")), ("b", 1, h("y"))], "g string, key int, leaf string")
    work = work_dir(spark, "merkle-test")
    m = merkle.manifest(leaves, ["key"], work)
    told = lambda row, path, subroot, root: (row[1],)
    with pytest.raises(Exception, match="has no path"):
        merkle.proofs(m.groups, m.above.where("g = 'a'"), work, ["key"], "key long", told).collect()
