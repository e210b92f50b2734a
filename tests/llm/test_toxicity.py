import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import toxicity as tx


def corpus(n, seed):
    """Plain words; toxic texts also have a seed insult, an invented insult or an invented stem with any ending."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows = []
    for i in range(n):
        ws, bad = [word() for _ in range(rng.randint(8, 60))], rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 3)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "Moron!", "zorgle", "quixna" + word()]))
        rows.append((i, " ".join(ws) + ".", int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    odd = [(None, None, 1, "y"), (5000, "", 2, "y"), (5001, "z " * 600_000 + "\nYOU IDIOT", 3, "z"), (5001, "z " * 600_000 + "\nYOU IDIOT", 3, "z"), (None, "a", 1, None)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t, _ in rows] + odd, "doc_id long, text string, score int, lang string").repartition(4)
    labels = spark.createDataFrame([(i, q, "n") for i, _, q in rows] + [(None, 1, "n"), (6000, None, "n"), (3, 7, "n")], "doc_id long, toxic int, text string")
    out = tx.scored(docs, tx.fit(docs, labels, labelled=500))
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = out.collect()
    assert len(got) == 905 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by_id[i] == q for i, q in held]) > 0.95
    assert by_id[5000] == 0 and by_id[5001] == 1


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one, two = (spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, _, q in rows], "doc_id long, toxic int") for flip in (False, True))
    a, b = tx.fit(docs, one), tx.fit(docs, two)
    assert a.places == b.places and (a.weights == b.weights).all()
    assert [r[0] for r in docs.select(tx.held_out(F.col("doc_id"))).collect()] == [held(i) for i, _, _ in rows]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert [r["score"] for r in tx.scored(docs, model).collect()] == [0.5, 0.5]
    assert tx.scored(docs.limit(0), model).count() == 0


def test_label_model_finds_rates_and_the_voter_that_repeats_another():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.3
    on, off = np.array([0.7, 0.6, 0.5, 0.65, 0.2]), np.array([0.05, 0.1, 0.02, 0.1, 0.2])
    fires = (rng.random((6000, 5)) < np.where(truth[:, None], on, off)).astype("f8")
    # The sixth voter says what the first says, nearly always: no news of the truth.
    fires = np.c_[fires, np.where(rng.random(6000) < 0.97, fires[:, 0], 1 - fires[:, 0])]
    start = np.where(fires[:, 1] + fires[:, 2] + fires[:, 3] >= 2, 0.9, 0.2)
    model, posterior = tx.LabelModel.fit(fires, start, rounds=40)
    assert model.parent[5] == 0 or model.parent[0] == 5
    assert abs(model.prior - 0.3) < 0.04
    rate = fires[truth].mean(axis=0)
    for j in (1, 2, 3, 4):
        assert model.parent[j] >= 0 or abs(model.rates[1, 0, j] - rate[j]) < 0.06
    independent = tx.LabelModel(np.full(6, -1))
    independent.maximise(fires, truth.astype("f8"))
    alike = (fires[:, 0] == 1) & (fires[:, 1:5].sum(axis=1) == 0) & (fires[:, 5] == 1)
    assert posterior[alike].mean() < independent.posterior(fires)[alike].mean()
    assert ((posterior > 0.5) == truth).mean() > 0.9


def test_linear_reaches_the_minimum():
    rng = np.random.default_rng(4)
    x = (rng.random((400, 12)) < 0.3).astype("f4")
    target = 1 / (1 + np.exp(-(x @ rng.normal(0, 2, 12) - 1)))
    w = tx.linear(x, target)
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(400)] @ w)))
    slope = np.c_[x, np.ones(400)].T @ (target - p) - np.r_[np.ones(12), 1e-3] * w
    assert np.abs(slope).max() < 0.02


def test_whole_texts_are_looked_at():
    long = "ab " * 500_000 + "zorgle!! sh*t"
    words, shown = tx.looked_at(long)
    assert words == {"ab", "zorgle", "sh", "t"} and shown == [False, False, True, False, True]
    assert tx.looked_at("YOU ARE AN IDIOT !")[1] == [True, False, False, True, False]
    assert tx.looked_at(None) == (set(), [False] * 5)
    assert "zor-" in tx.traits({"zorgle"}) and "zorgle" in tx.traits({"zorgle"})
    assert len(list(tx.segments("a" * 3_000_000))) == 3
