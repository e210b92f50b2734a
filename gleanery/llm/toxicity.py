"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posteriors.

Voters fire or abstain on a text: insults of a seed lexicon; words and word beginnings that a bounded sample of labelled
rows associates with toxicity; patterns (shouting, exclamations, masked letters, insults after an address, words said over and
over); and the sample's own labels, which may be wrong as any voter may. For each class of a hidden truth the label model has the
rate at which each voter fires, and, since voters overlap ("idiot", "idio..."), the rate given whether one other voter fired:
lexicon and pattern voters form a tree of the strongest dependences within the classes (Chow and Liu, 1968). Expectation
maximisation fits rates and the share of toxic texts.

The posterior of each sample text is the target of a logistic regression over the presence of the associated words and
beginnings and the patterns, which knows more words than vote. Its size depends on parameters only; texts are scored where they
are read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import kept_by, lean, small_batches, work_dir, write_bytes

#: Bounds of the model: labelled rows of the sample, words and beginnings known, those of them that vote.
LABELLED, KNOWN, VOTERS = 8192, 2048, 256
#: Texts that a known word occurs in at least, its association in standard deviations, toxic share of one that votes.
LEAST_TEXTS, LEAST_Z, VOTER_SHARE = 4, 3.0, 0.75
#: Lengths of word beginnings; characters of a text looked at at once.
BEGINNINGS, SEGMENT = range(3, 9), 1 << 20
#: Traits that a task counts before it tells them.
TRAITS_HELD = 1 << 18
#: Insults of four languages, each a voter.
SEED = (
    "idiot moron stupid worthless trash scum clown pathetic disgusting loser dumb fool imbecile jerk pig retard ugly filthy vermin bastard "
    "dumm dummkopf trottel versager abschaum widerlich arschloch schwein drecksack "
    "imbécile crétin débile abruti ordure connard minable stupide dégoûtant "
    "idiota imbécil estúpido basura asqueroso patético payaso inútil cerdo"
).split()
_ADDRESS = "you your yourself du dein dich ihr tu toi ton vous votre usted eres eras"
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
_DIRECT = re.compile(rf"\b(?:{'|'.join(_ADDRESS.split())})\b(?:\s+\w+){{0,3}}?\s+(?:{'|'.join(SEED)})\b")
_SEED = frozenset(SEED)
#: Names of the pattern voters, in the order of ``patterns``.
PATTERNS = ("shouting", "exclaiming", "masked letters", "insult after an address", "said over and over")


def segments(text: str) -> Iterator[str]:
    """A text in parts of about ``SEGMENT`` characters, cut at white space where there is some."""
    a = 0
    while len(text) - a > SEGMENT:
        b = text.rfind(" ", a, a + SEGMENT)
        b = a + SEGMENT if b <= a else b
        yield text[a:b]
        a = b
    yield text[a:]


def looked_at(text: str | None) -> tuple[set[str], list[bool]]:
    """The distinct words (runs of letters) of a whole text in lower case, and which patterns it shows."""
    words: set[str] = set()
    size = capitals = marks = 0
    masked = direct = again = False
    for part in segments(text or ""):
        lower = part.lower()
        tokens = lower.split()
        size += len(tokens)
        marks += part.count("!")
        capitals += len(_CAPITALS.findall(part))
        again = again or any(x == y == z for x, y, z in zip(tokens, tokens[1:], tokens[2:]))
        for token in set(tokens):
            if token.isalpha():
                words.add(token)
            else:
                words.update(_WORD.findall(token))
                masked = masked or _MASKED.search(token) is not None
        if not direct and not _SEED.isdisjoint(words):
            direct = _DIRECT.search(lower) is not None
    return words, [2 * capitals > size > 0, 4 * marks > size > 0, masked, direct, again]


def beginnings(word: str) -> list[str]:
    return [word[:k] + "-" for k in BEGINNINGS if len(word) > k]


def traits(words: set[str]) -> set[str]:
    """Words and word beginnings (marked by a hyphen) of a text."""
    return words | {b for w in words for b in beginnings(w)}


def voter_tree(fires: np.ndarray, posterior: np.ndarray, least: float = 0.01) -> np.ndarray:
    """For each voter the voter that it depends on, or -1: the tree with the largest sum of mutual information within the
    classes, without branches below ``least`` nats."""
    n, m = fires.shape
    share = np.zeros((m, m))
    for weight in (posterior, 1 - posterior):
        total = max(weight.sum(), 1e-9)
        both = (fires * weight[:, None]).T @ fires / total
        one = np.diag(both).copy()
        for a, b, joint in ((0, 0, both), (0, 1, one[:, None] - both), (1, 0, one[None, :] - both), (1, 1, 1 - one[:, None] - one[None, :] + both)):
            left, right = (one if a == 0 else 1 - one)[:, None], (one if b == 0 else 1 - one)[None, :]
            ratio = np.maximum(joint, 1e-12) / np.maximum(left * right, 1e-12)
            share += total / n * np.where(joint > 1e-12, joint * np.log(ratio), 0)
    parent, near, best = np.full(m, -1), np.full(m, -1), np.full(m, -np.inf)
    out = np.ones(m, "?")
    at = 0
    for _ in range(m - 1):
        out[at] = False
        closer = out & (share[at] > best)
        best[closer], near[closer] = share[at][closer], at
        at = int(np.argmax(np.where(out, best, -np.inf)))
        parent[at] = near[at] if best[at] >= least else -1
    return parent


@dataclass
class LabelModel:
    """Rates at which voters fire in each class, given whether the voter they depend on fired."""

    parent: np.ndarray
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 0)))  # class, parent fired, voter
    prior: float = 0.5

    def maximise(self, fires: np.ndarray, posterior: np.ndarray) -> None:
        has = self.parent >= 0
        above = np.where(has, fires[:, np.maximum(self.parent, 0)], 0)
        self.rates = np.empty((2, 2, fires.shape[1]))
        for c, weight in enumerate((1 - posterior, posterior)):
            alone = (weight @ fires + 0.2) / (weight.sum() + 1)
            for on in (0, 1):
                given = (above == on) * weight[:, None]
                own = ((given * fires).sum(axis=0) + 2 * alone) / (given.sum(axis=0) + 2)
                self.rates[c, on] = np.clip(np.where(has, own, alone), 1e-4, 1 - 1e-4)
        self.prior = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, fires[:, np.maximum(self.parent, 0)], 0)
        logit = np.full(len(fires), np.log(self.prior / (1 - self.prior)))
        for c, sign in ((1, 1), (0, -1)):
            rate = np.where(above == 1, self.rates[c, 1], self.rates[c, 0])
            logit += sign * np.where(fires == 1, np.log(rate), np.log1p(-rate)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    @classmethod
    def fit(cls, fires: np.ndarray, start: np.ndarray, alone: int = 0, rounds: int = 12) -> tuple["LabelModel", np.ndarray]:
        """``start``: first guesses of the posterior, which say which of the two classes is the toxic one. Dependences are
        those within its classes, since voters that repeat each other would else pass for the truth; the last ``alone``
        voters have none."""
        inner = fires.shape[1] - alone
        model, posterior = cls(np.r_[voter_tree(fires[:, :inner], start), np.full(alone, -1)]), start
        for _ in range(rounds):
            model.maximise(fires, posterior)
            posterior = model.posterior(fires)
        return model, posterior


def linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 15, inner: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft targets, the intercept last: Newton steps, each solved by conjugate
    gradients. ``x`` is in single precision and stays so."""
    x = np.c_[x, np.ones(len(x), "f4")]
    times, back = lambda v: (x @ v.astype("f4")).astype("f8"), lambda v: (x.T @ v.astype("f4")).astype("f8")
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope = back(target - p) - keep * w
        curve = np.maximum(p * (1 - p), 1e-6)
        step, left = np.zeros_like(w), slope.copy()
        way, size = left.copy(), left @ left
        enough = 1e-6 * size
        for _ in range(inner):
            if size <= enough:
                break
            bent = back(curve * times(way)) + keep * way
            far = size / (way @ bent)
            step += far * way
            left -= far * bent
            size, before = left @ left, size
            way = left + size / before * way
        w += step
        if np.abs(step).max(initial=0) < 1e-3:
            break
    return w


@dataclass
class Model:
    """Places of known words and beginnings, and the weights of these, of patterns, and of nothing."""

    places: dict[str, int]
    weights: np.ndarray
    votes: LabelModel | None = None

    def __post_init__(self) -> None:
        self.starts = {t[: BEGINNINGS[0]] for t in self.places}

    def hits(self, words: set[str], shown: list[bool]) -> list[int]:
        """Places of what a text shows."""
        places, starts, first = self.places, self.starts, BEGINNINGS[0]
        hit = {len(places) + k for k, s in enumerate(shown) if s}
        for w in words:
            if w[:first] in starts:
                hit.update(places[t] for t in (w, *beginnings(w)) if t in places)
        return sorted(hit)

    def score(self, text: str | None) -> float:
        z = float(self.weights[self.hits(*looked_at(text))].sum() + self.weights[-1])
        return 1 / (1 + np.exp(-min(max(z, -30), 30)))


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, labelled: int) -> DataFrame:
    """``id, label, text`` of the ``labelled`` ids with the smallest hashes among those that may be learned from. Rows
    without an id, a text or a label of 0 or 1 teach nothing; an id with both labels counts as 0."""
    taught = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    taught = taught.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = taught.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # At most ``labelled`` rows of two integers: the size of this broadcast is a parameter.
    return texts.join(F.broadcast(chosen), "id")


def known_traits(rows: DataFrame, known: int) -> list[tuple[str, int, int]]:
    """``trait, texts, toxic texts`` of the ``known`` words and beginnings most associated with toxicity in the sample."""

    def told(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(counts, pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["trait", "texts", "toxic_texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(*(batch.column(c).to_pylist() for c in range(2))):
                for t in traits(looked_at(text)[0]):
                    c = counts.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += label
                if len(counts) > TRAITS_HELD:
                    yield told(counts)
                    counts = {}
        yield told(counts)

    counts = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    each = rows.select("label", "text").mapInArrow(lean("toxicity", run), "trait string, texts long, toxic_texts long")
    each = each.groupBy("trait").agg(F.sum("texts").alias("texts"), F.sum("toxic_texts").alias("toxic_texts")).where(F.col("texts") >= LEAST_TEXTS)
    share = F.col("toxic") / F.col("n")
    z = (F.col("toxic_texts") - F.col("texts") * share) / F.sqrt(F.col("texts") * share * (1 - share) + F.lit(1e-9))
    # One row of two sums beside each trait.
    ranked = each.join(F.broadcast(counts)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return [tuple(r) for r in ranked.orderBy(F.desc("z"), "trait").limit(known).select("trait", "texts", "toxic_texts").collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    labelled: int = LABELLED,
    known: int = KNOWN,
    voters: int = VOTERS,
) -> Model:
    """Learn from ``labelled`` rows at most, of which every word and pattern is looked at in Spark tasks; the driver gets
    ``known`` traits with two counts each, and for each sample row the places of its traits."""
    rows = sample(docs, labels, label_col, id_col, text_col, labelled)
    chosen = known_traits(rows, known)
    names = [t for t, _, _ in chosen]
    names += [s for s in SEED if s not in set(names)]
    places = {t: k for k, t in enumerate(names)}
    model = Model(places, np.zeros(len(places) + len(PATTERNS) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.array(model.hits(*looked_at(text)), "<i4").tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.binary())], ["label", "hits"])

    # Ids may repeat: the bound holds for rows before any of them reaches the driver.
    got = rows.select("label", "text").mapInArrow(lean("toxicity", run), "label int, hits binary").orderBy("label", "hits").limit(labelled).toPandas()
    if not len(got):
        return model
    x = np.zeros((len(got), len(places) + len(PATTERNS)), "f4")
    for i, hits in enumerate(got["hits"]):
        x[i, np.frombuffer(bytes(hits), "<i4")] = 1
    told = got["label"].to_numpy("f8")
    strong = [places[t] for t, texts, toxic in chosen if toxic >= VOTER_SHARE * texts][:voters]
    voting = sorted({*strong, *(places[s] for s in SEED), *range(len(places), x.shape[1])})
    fires = x[:, voting].astype("f8")
    votes, posterior = LabelModel.fit(np.c_[fires, told], 0.05 + 0.9 * told, alone=1)
    return Model(places, linear(x, posterior), votes)


_MODELS: dict[str, Model] = {}
kept_by("toxicity", _MODELS.clear)


def _model(name: str) -> Model:
    if name not in _MODELS:
        _MODELS.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _MODELS[name] = pickle.load(f)
    return _MODELS[name]


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with a score (0 to 1, higher: label 1 likelier) and a prediction (1 from ``threshold``
    on), which take the place of columns of the same ``names``. Null texts count as empty. Nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    work = work_dir(spark, "toxicity")
    name = work.rsplit("/", 1)[1] + ".bin"
    write_bytes(spark, f"{work}/{name}", pickle.dumps(Model(model.places, model.weights)))
    spark.sparkContext.addFile(f"{work}/{name}")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in names))
    at = docs.columns.index(text_col)
    columns = [f"c{k}" for k in range(len(docs.columns))]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema)) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for batch in batches:
            score = np.array([model.score(t) for t in batch.column(at).to_pylist()], "f8")
            extra = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype("i4"), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*columns, "score", "predicted"])

    return docs.toDF(*columns).mapInArrow(lean("toxicity", run), schema).toDF(*docs.columns, *names)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
