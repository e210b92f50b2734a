import random
import zlib

import numpy as np

from gleanery.llm.quality import Model, fit, scored, term_rows


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows = []
    for i in range(n):
        ws, kind = [word() for _ in range(rng.randint(8, 60))], rng.randint(0, 4)
        bad = kind > 1
        text = " ".join(ws) + "."
        if kind == 2:
            text = " ".join(w + "&&&" for w in ws)
        if kind == 3:
            text = text.upper().replace(" ", "!! ")
        if kind == 4:
            text = " ".join([ws[0]] * len(ws))
        rows.append((i, text, int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(800, 1)
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t, _ in rows] + [(None, None, 1, "y"), (5000, "", 2, "y"), (5001, "z " * 60_000, 3, "z"), (5001, "z " * 60_000, 3, "z")], "doc_id long, text string, score int, lang string").repartition(4)
    labels = spark.createDataFrame([(i, q, "n") for i, _, q in rows] + [(None, 1, "n"), (6000, None, "n"), (3, 7, "n")], "doc_id long, quality int, text string")
    model = fit(docs, labels, "quality", labelled=400)
    assert len(model.labels) == 400
    out = scored(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = out.collect()
    assert len(got) == 804 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([by_id[i] == q for i, q in held]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    one, two = (spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, _, q in rows], "doc_id long, quality int") for flip in (False, True))
    a, b = fit(docs, one, "quality"), fit(docs, two, "quality")
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


def test_scores_equal_plain_neighbours():
    rng = np.random.default_rng(1)
    rows = term_rows([t for _, t, _ in corpus(300, 3)])
    model = Model.fit(rows[:200], rng.integers(0, 2, 200))
    v = (rows[200:] * model.weights) @ model.axes
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k, got in enumerate(model.scores(rows[200:])):
        sim = np.rint(model.vectors @ v[k] * 1e4).astype("f8")
        near = np.argsort(-sim, kind="stable")[: model.neighbours]
        w = (np.maximum(sim[near], 0) / 1e4) ** 8
        assert abs(got - (w * model.labels[near]).sum() / w.sum()) < 1e-9


def test_rows_do_not_depend_on_their_batch():
    texts = [t for _, t, _ in corpus(40, 4)] + ["", None, "\n\n", "a\n\nb\n\na", "É É x", "w " * 700_000]
    whole = term_rows(texts)
    assert all((whole[k] == term_rows([t])[0]).all() for k, t in enumerate(texts))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit(docs, labels, "quality")
    assert [r["score"] for r in scored(docs, model).collect()] == [0.5, 0.5]
    assert scored(docs.limit(0), model).count() == 0
