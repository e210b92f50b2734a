"""Near duplicates of the pipeline against all pairs in plain Python, with texts that SimHash of words confuses."""

import random

import corpus_pipeline
from gleanery.llm import simhash
from gleanery.llm.simhash import near_groups
from tests.llm.test_simhash import plain_components


def plain_shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_similar(a, b):
    x, y = plain_shingles(a), plain_shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    common = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(60):
        ws = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(ws) + (" " + common if rng.random() < 0.5 else ""))
        for _ in range(rng.randint(0, 4)):
            ws = list(ws)
            for _ in range(rng.randint(1, 3)):
                ws[rng.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    base = [word() for _ in range(20)]
    texts += [" ".join(base), " ".join(base * 30), " ".join(rng.sample(base, 20)), "", " ", None, "One two", "one  two", "one two three"]
    texts += [texts[3]] * 5 + [texts[4] + " tail"] * 5
    return list(enumerate(texts))


def saved(spark, rows, path):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def links(rows):
    return {(a, b) for a in range(len(rows)) for b in range(a) if plain_similar(rows[a][1], rows[b][1])}


def test_no_link_is_false_and_few_are_missed(spark, tmp_path):
    rows = corpus()
    docs = saved(spark, rows, f"{tmp_path}/d")
    got = {}
    for r in near_groups(docs).collect():
        got.setdefault(r["root"], []).append(r["doc_id"])
    true = links(rows)
    for members in got.values():  # each group hangs together by true links
        assert len(set(plain_components([(a, b) for a, b in true if a in members and b in members], len(rows))[i] for i in members)) == 1
    of = {i: root for root, members in got.items() for i in members}
    met = sum(a in of and of.get(a) == of.get(b) for a, b in true)
    assert len(true) > 150 and met >= 0.9 * len(true)


def test_every_candidate_counts(spark, tmp_path, monkeypatch):
    """With a radius that misses nothing on this corpus, groups are those of all pairs; crowded patterns change nothing."""
    rows = corpus(9)
    docs = saved(spark, rows, f"{tmp_path}/d")
    comp = plain_components(links(rows), len(rows))
    want = {}
    for (i, _), c in zip(rows, comp):
        want.setdefault(c, set()).add(i)
    for crowd in (4096, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {}
        for r in near_groups(docs, bits=6, tables=4).collect():
            got.setdefault(r["root"], set()).add(r["doc_id"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)


def test_stage_keeps_same_words_in_another_order(spark, tmp_path):
    """SimHash of distinct words drops the second and third; both are unlike the first."""
    base = [f"w{k}" for k in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join(base[::-1])), (3, " ".join((base[::2] + base[1::2]) * 30)), (4, " ".join([f"v{k}" for k in range(99)])), (5, " ".join([f"v{k}" for k in range(98)]))]
    out = corpus_pipeline.near_stage(spark, saved(spark, rows, f"{tmp_path}/d"), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 4]
    assert corpus_pipeline.near_stage(spark, saved(spark, [], f"{tmp_path}/e"), "").count() == 0


def test_one_of_each_group_stays_with_null_and_repeated_ids(spark, tmp_path):
    text = [" ".join(f"{g}{k}" for k in range(199)) for g in "abc"]
    rows = [(7, text[0]), (7, text[0] + " x"), (None, text[0] + " y"), (None, text[1]), (None, text[1] + " x"), (None, text[2]), (3, text[2] + " x")]
    out = corpus_pipeline.near_stage(spark, saved(spark, rows, f"{tmp_path}/d"), "")
    got = [(r["doc_id"], r["text"][0]) for r in out.collect()]
    assert sorted(got, key=str) == [(3, "c"), (7, "a"), (None, "b")]


def test_a_pair_is_found_under_one_mask():
    import numpy as np

    masks = simhash.choices(3, 2)
    first = simhash.foremost(masks, 3)
    rng = random.Random(3)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        hits = [m for m in masks if not x & m and first(np.array([m], "u8"), np.array([x], "u8"))[0]]
        assert len(hits) == 1
        finer = [hits[0] | t for t in simhash.free_parts(hits[0], 4)]
        assert sum(not x & m and first(np.array([m], "u8"), np.array([x], "u8"))[0] for m in finer) == 1


def test_pairs_come_once_however_they_are_cut(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 12, 900).astype("u8"))
    mask = np.full(len(fp), 0xFFFFFFFFFFFFF000, "u8")
    want = {(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3}
    for cut in (1 << 19, 7):
        monkeypatch.setattr(simhash, "PAIRS", cut)
        a, b = simhash.linked(mask, fp & mask, fp, 3)
        assert len(a) == len(want) and {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == want
