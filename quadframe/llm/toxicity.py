"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two words sums, over all subsequences of three or four characters inside six, the product of
both words' weights for it, DECAY to the power of the length spanned; words are framed by marks, and the kernel
is divided by what the lengths alone make of it.  So an insult with gaps or inserted characters still
shares most of its subsequences.  A sentence is as toxic as its worst word, a document as its worst sentence.

Training reads sentences of labelled documents, each sentence once; a sentence has its document's label.
It is a multiple-instance SVM: which words make a toxic document toxic is not known, so witnesses are
chosen in rounds, see ``train_words``.  Over the Nystroem map of the kernel at the landmarks, a
squared-hinge SVM tells witnesses from words of clean sentences.  A sum of kernels with fixed landmarks is one weight
for each subsequence, so words are scored without touching the landmarks again.  A logistic regression with
balanced classes then turns a document's worst words into a score, on a fifth of the labelled rows kept apart
from the words' training.

Letters set apart by white space are joined; an insult cut by a space into parts of several letters is not.

Defined results: null and empty texts have no words and get the lowest scores; rows are scored each, whether
their id or text repeats or is null; labels without an id teach nothing, and an id's repeated labels count as toxic
if one is; a row without an id isn't held out; with fewer than two classes of labels every score is their
share of toxic ones, 0 without labels; an empty table gives an empty result; more columns are neither
read nor in the way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadframe.llm.common import cut, for_python, read_spread, read_table, release, text_or_empty
from quadframe.llm.words import text_batches

#: Labelled rows that are used for training at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Words of each side that training sees at most, and landmarks of each side.
TOXIC_WORDS, CLEAN_WORDS, LANDMARKS = 6_000, 30_000, 96
#: Clean words of each kind that the SVM sees: frequent, random, and mistaken in the round before.
ACTIVE = 3_000
#: Words of a toxic document that may be witnesses in a round; the excess over which a word is one anyway.
WITNESSES, SURE = 2, 4.0
ROUNDS = 4

DECAY = 0.6
SPAN = 6
LONGEST = 18
_BITS = 20
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¿¡"
_CACHE = 250_000
_LETTERS = re.compile(r"(?<!\S)(?:\S\s{1,3}){2,}\S(?!\S)")
#: Characters of text that are split into words at a time.
_SLICE = 1_000_000


def spans(text: str) -> list[str]:
    """The words of a text in lower case; three or more letters set apart by up to three white-space characters
    each also count as one word."""
    words = text.lower().split()
    words += ["".join(x.split()).lower() for x in _LETTERS.findall(text)]
    return words


@lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of all subsequences in a word of n characters, their weights, and the norm of these.

    A subsequence of three characters has n as its fourth place.
    """
    at = [(i, *rest, *[n] * (3 - len(rest))) for i in range(n) for size in (2, 3) for rest in combinations(range(i + 1, min(n, i + SPAN)), size)]
    at = np.array(at, np.int64).reshape(-1, 4)
    last = np.where(at[:, 3] == n, at[:, 2], at[:, 3])
    weight = DECAY ** (last - at[:, 0] + 1.0) if len(at) else np.zeros(0)
    return at, weight, float(np.sqrt((weight**2).sum())) or 1.0


def pieces(word: str) -> list[str]:
    """A word framed by marks; a long one as overlapping windows."""
    word = "^" + word.strip(_EDGE) + "$"
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of equally long pieces: places in ``words``, cells of the subsequences, weights."""
    cut = [(len(p), i, p) for i, w in enumerate(words) for p in pieces(w)]
    cut.sort(key=lambda x: x[0])
    out, begin = [], 0
    for k in range(len(cut) + 1):
        if k == len(cut) or cut[k][0] != cut[begin][0] or k - begin >= 4096:
            if k > begin:
                some = cut[begin:k]
                n = some[0][0]
                at, weight, norm = _places(n)
                code = np.frombuffer("".join(p for _, _, p in some).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
                code = np.hstack([code, np.zeros((len(some), 1), np.uint64)])
                h = (code[:, at[:, 0]] * np.uint64(0x9E3779B1) + code[:, at[:, 1]]) * np.uint64(0x85EBCA77) + code[:, at[:, 2]]
                h = ((h * np.uint64(0x27D4EB2F165667C5) + code[:, at[:, 3]]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)
                out.append((np.array([i for _, i, _ in some]), h.astype(np.int32), (weight / norm).astype(np.float32)))
            begin = k
    return out


def weigh(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The decision for each word: the largest of its pieces."""
    score = np.full(len(words), -np.inf, np.float32)
    for i, cells, weight in features(words):
        np.maximum.at(score, i, weights[cells] @ weight)
    return score


@dataclass
class Model:
    """``weights``: of the subsequences; ``bias``; ``link``: coefficients of the logistic regression."""

    weights: np.ndarray
    bias: float
    link: np.ndarray


class _Scorer:
    """Scores of words with a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text: its largest decision, that of its second different word, how many words are positive and how
        many there are (logarithms)."""
        cut = [spans(t) for t in texts]
        distinct = set(chain.from_iterable(cut))
        table = {w: self.young[w] for w in distinct if w in self.young}
        missing = []
        for w in distinct:
            if w not in table:
                if w in self.old:
                    table[w] = self.young[w] = self.old[w]
                else:
                    missing.append(w)
        got = np.clip(weigh(missing, self.model.weights) + np.float32(self.model.bias), -3, 3).tolist()
        new = dict(zip(missing, got, strict=True))
        table.update(new)
        self.young.update(x for x in new.items() if len(x[0]) < 64)
        if len(self.young) > _CACHE:
            self.old, self.young = self.young, {}
        out = np.zeros((len(texts), 4))
        out[:, :2] = -3
        counts = [len(c) for c in cut]
        score = np.fromiter(map(table.__getitem__, chain.from_iterable(cut)), np.float32, sum(counts))
        end = 0
        for i, n in enumerate(counts):
            own, end = score[end : end + n], end + n
            if n:
                first = own.max()
                rest = own[own < first]
                out[i] = first, rest.max() if len(rest) else -3, np.log1p(float((own > 0).sum())), np.log1p(n)
        return out


def _probability(evidence: np.ndarray, link: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence @ link[:-1] + link[-1], -30, 30)))


def _apply(model: Model, raw: bool) -> Callable:
    names = ["doc_id", *(["e0", "e1", "e2", "e3"] if raw else ["score"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            texts, parts = batch.column(1).to_pylist(), []
            for part in text_batches(texts, _SLICE):
                e = scorer.evidence(texts[part])
                parts.append(e if raw else _probability(e, model.link)[:, None])
            all_ = np.concatenate(parts) if parts else np.zeros((0, len(names) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(all_[:, k]) for k in range(all_.shape[1]))], names=names)
        release()

    return run


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton's method on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(steps):
        on = y * (x1 @ w) < 1
        a = x1[on]
        c = strength * weight[on]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(ridge), a.T @ (c * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression in which both classes weigh the same, so 0.5 lies between them however rare one is."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    weight = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class _Landmarks:
    """The Nystroem map of the kernel at some words."""

    def __init__(self, words: list[str]):
        made = features(words)
        self.cells = np.unique(np.concatenate([c.ravel() for _, c, _ in made]))
        self.vectors = np.zeros((len(self.cells) + 1, len(words)), np.float32)  # the last row: other cells
        for i, cells, weight in made:
            np.add.at(self.vectors, (np.searchsorted(self.cells, cells), i[:, None]), weight)
        value, vector = np.linalg.eigh((self.vectors.T @ self.vectors).astype(np.float64))
        keep = value > 1e-6 * value.max()
        self.root = vector[:, keep] / np.sqrt(value[keep])

    def map(self, words: list[str]) -> np.ndarray:
        kernel = np.full((len(words), self.vectors.shape[1]), -np.inf, np.float32)
        for i, cells, weight in features(words):
            place = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            place[self.cells[place] != cells] = len(self.cells)
            for k in range(0, len(i), 64):
                np.maximum.at(kernel, i[k : k + 64], np.einsum("ncl,c->nl", self.vectors[place[k : k + 64]], weight))
        return kernel @ self.root

    def weights(self, w: np.ndarray) -> np.ndarray:
        full = np.zeros(1 << _BITS, np.float32)
        full[self.cells] = self.vectors[:-1] @ (self.root @ w)
        return full


def _decisions(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, weights: np.ndarray) -> np.ndarray:
    """The decision for each of n words whose features are made already: the largest of its pieces."""
    score = np.full(n, -np.inf, np.float32)
    for i, cells, weight in made:
        np.maximum.at(score, i, weights[cells] @ weight)
    return score


def train_words(toxic: list[tuple[str, float, int]], clean: list[tuple[str, int]], bags: list[list[int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the subsequences and the bias: a multiple-instance SVM.

    ``toxic``: candidates (word, excess, toxic sentences), the strongest first; ``clean``: rows (word, clean
    sentences), the most frequent first; ``bags``: for each toxic document its candidates' places in
    ``toxic``.  A toxic document has toxic words, but which is not known: the witnesses.  First these are the
    candidates of great excess, later also the ``WITNESSES`` with the largest decisions in each bag, if
    positive.  Landmarks are the witnesses of most bags, frequent clean words, and the clean words
    that the last round took for toxic most; the SVM sees all witnesses against frequent, random and
    mistaken clean words.
    """
    words = [*(w for w, _, _ in toxic), *(w for w, _ in clean)]
    n, made = len(toxic), features(words)
    often = np.array([np.log1p(c) for _, c in clean])
    sure = np.zeros(n)
    for k, (_, excess, a) in enumerate(toxic):
        if k < 20 or excess >= SURE:
            sure[k] = np.log1p(a)
    step = max(1, len(clean) // landmarks)
    even = [w for w, _ in clean[::step][:landmarks]]
    negative = np.unique(np.concatenate([np.arange(min(len(clean), ACTIVE)), np.arange(0, len(clean), max(1, len(clean) // ACTIVE))]))
    mass, hard, decision = sure.copy(), np.zeros(0, np.int64), None
    weights, bias = np.zeros(1 << _BITS, np.float32), 0.0
    for _ in range(rounds):
        if decision is not None:
            votes = np.zeros(n)
            for bag in bags:
                own = np.array(bag)
                top = own[np.argsort(-decision[own], kind="stable")[:WITNESSES]]
                votes[top[decision[top] > 0]] += 1
            mass = np.maximum(sure, np.log1p(votes))
            order = np.argsort(-decision[n:], kind="stable")
            hard = order[:ACTIVE]
        strong = [words[i] for i in np.argsort(-mass, kind="stable")[:landmarks] if mass[i]]
        marks = _Landmarks(list(dict.fromkeys([*strong, *even, *(words[n + i] for i in hard[:landmarks])])))
        positive, others = np.flatnonzero(mass), np.union1d(negative, hard)
        use = [*positive.tolist(), *(n + others).tolist()]
        x = marks.map([words[i] for i in use])
        y = np.where(np.arange(len(use)) < len(positive), 1.0, -1.0)
        weight = np.concatenate([mass[positive] * (often[others].sum() / max(mass.sum(), 1e-9) / 4), often[others]])
        w, bias = svm(x, y, weight)
        weights = marks.weights(w)
        decision = _decisions(made, len(words), weights) + bias
    return weights, bias


def _trained(spark: SparkSession, toxic: list, clean: list, bags: list) -> tuple[np.ndarray, float]:
    """``train_words`` in a task, so that its arrays never stand in the driver's memory; its input is bounded by the
    parameters above."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = train_words(toxic, clean, bags)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])
        del weights
        release()

    row = spark.range(1, numPartitions=1).mapInArrow(run, "weights binary, bias double").first()
    return np.frombuffer(row["weights"], "<f4").astype(np.float32), row["bias"]


def _chosen(labels: DataFrame, train_rows: int) -> DataFrame:
    """``(doc_id, toxic, fold)`` of at most ``train_rows`` labelled documents outside fold 0: those with the
    smallest hashes.  A document with several labels counts as toxic if one is."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = rows.withColumn("fold", fold).withColumn("h", F.xxhash64("doc_id"))
    n = rows.count()
    if n > 2 * train_rows:  # half as many again as are needed, so that the sort below stays small
        rows = rows.where(F.col("h") < int(2**64 * (1.5 * train_rows + 1000) / n) - 2**63)
    return rows.orderBy("h", "doc_id").limit(train_rows).drop("h")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``.

    A label's row counts if ``crc32(doc_id) mod 5`` is not 0: 1 to 3 train the words, 4 the logistic
    regression.  What comes to the driver is bounded by the parameters above, whatever the input: words by
    their numbers, and one row for each chosen document.
    """
    chosen = cut(_chosen(labels, train_rows))
    empty = np.zeros(1 << _BITS, np.float32)
    share = chosen.agg(F.avg("toxic")).first()[0] or 0.0
    constant = Model(empty, 0.0, np.array([0, 0, 0, 0, float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30))]))
    if share in (0.0, 1.0):
        return constant
    # train_rows rows of three numbers; kept, so the documents are read once
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").persist(StorageLevel.DISK_ONLY)
    try:
        return _fit(texts, chosen, constant)
    finally:
        texts.unpersist()


def _fit(texts: DataFrame, chosen: DataFrame, constant: Model) -> Model:
    sentence = texts.where("fold <> 4").select("toxic", F.explode(F.split("text", r"[.!?\n]+")).alias("s")).distinct()
    in_words = F.explode(F.array_distinct(F.split(F.lower("s"), r"[ \t\r\f]+"))).alias("w")
    bare = F.expr("trim(BOTH '" + _EDGE.replace("\\", "\\\\").replace("'", "\\'") + "' FROM w)").alias("w")
    word = sentence.select("toxic", in_words).select("toxic", bare).where("length(w) between 3 and 40")
    counts = word.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c")).coalesce(8).persist()
    total = counts.agg(F.sum("a"), F.sum("c")).first()
    if not total[0] or not total[1]:
        return constant
    base = total[0] / (total[0] + total[1])
    # how far a word's toxic sentences exceed what the base rate gives, in standard deviations
    excess = (F.col("a") - (F.col("a") + F.col("c")) * base) / F.sqrt((F.col("a") + F.col("c")) * (base * (1 - base)) + 1)
    toxic = [tuple(r) for r in counts.where(excess > 0).where("a > 4 * c").orderBy(excess.desc(), "w").limit(TOXIC_WORDS).select("w", excess, "a").collect()]
    often = counts.where("a <= 4 * c").orderBy(F.col("c").desc(), "w").limit(CLEAN_WORDS // 4).select("w", "c").collect()
    other = counts.where("a <= 4 * c").orderBy(F.xxhash64("w"), "w").limit(CLEAN_WORDS * 3 // 4).select("w", "c").collect()
    counts.unpersist()
    clean = sorted({tuple(r) for r in [*often, *other]}, key=lambda r: (-r[1], r[0]))
    if not toxic or not clean:
        return constant
    listed = texts.sparkSession.createDataFrame([(w, i) for i, (w, _, _) in enumerate(toxic)], "w string, i int")
    of_bags = texts.where("fold <> 4 and toxic = 1").select("doc_id", F.col("text").alias("s")).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("s"), r"[\s.!?]+"))).alias("w")).select("doc_id", bare)
    bags = of_bags.join(F.broadcast(listed), "w").groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("i")).select("i").distinct()
    weights, bias = _trained(texts.sparkSession, toxic, clean, [r["i"] for r in bags.collect()])
    del toxic, often, other, clean
    release()
    model = Model(weights, bias, np.zeros(5))
    kept = texts.where("fold = 4")
    seen = for_python(kept.select("doc_id", "text")).mapInArrow(_apply(model, True), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, e0 double, e1 double, e2 double, e3 double")
    one = seen.groupBy("doc_id").agg(F.max(F.struct("e0", "e1", "e2", "e3")).alias("e"))
    got = one.join(F.broadcast(chosen), "doc_id").select("toxic", "e.*").collect()
    y = np.array([r[0] for r in got], float)
    if not 0 < y.sum() < len(y):
        model.link = np.array([2.0, 0, 0, 0, 0])
        return model
    model.link = logistic(np.array([r[1:] for r in got], float), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row: the probability of the label toxic."""
    source = docs.select("doc_id", text_or_empty().alias("text"))
    return for_python(source).mapInArrow(_apply(model, False), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def _keep(model: Model, below: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in text_batches(texts, _SLICE):
                clean = _probability(scorer.evidence(texts[part]), model.link) < below
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(clean))
        release()

    return run


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score lies below a threshold."""
    return for_python(docs).mapInArrow(_keep(model, below), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, and whether its label was kept out of training."""
    docs = read_spread(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
