"""Toxicity by a subsequence string kernel over sentences, with Nystroem landmarks and a support vector machine.

A text is cut into sentences. Units of a sentence are its words with case, accents, look-alike digits and inner
punctuation folded away; runs of single letters ("s t u p i d") form one more unit, and a long unit is read in
overlapping windows of ``WINDOW`` letters. The kernel of two units sums lambda^(span x) * lambda^(span y) over common
subsequences of ``ORDER`` letters that span at most ``SPAN`` positions, normalised by length, so inserted letters and gaps
cost weight but don't hide a word. Letters are code points of any script. The kernel of two sentences is the sum over
pairs of their distinct units, divided by a power (``SHARE``) of both sentences' numbers of units.

Training, on a bounded sample of labelled rows (``MAX_TRAIN`` documents of each label, of at most ``MAX_TRAIN_CHARS`` code
points each, the lowest by hash of the id): every sentence inherits its document's label. Of a document of label 1, at
least one sentence must earn it: after the first fit these are the sentence that the machine values most and those
it is sure of; sentences of label 0 are a sample and the machine's own worst mistakes. Landmarks are sentences of both
labels; an L2-regularised squared-hinge machine is fitted on the Nystroem features, and again, ``ROUNDS`` times. As the
kernel is linear in its explicit features, hashed to ``BITS`` bits, the machine folds into one table of weights, which goes
with the tasks, and a sentence's value is the sum of its units' values. Last, a logistic regression maps what a
document amounts to (its three largest sentences and units, how many units lie above each of ``LEVELS`` and how
many units there are, so that a long text isn't worse for its length) to the score.

Defined cases: null or empty text has the score of a text without units; null doc_id is not held out and never
labelled; repeated rows give repeated results; several labels of one id count as 1 if any is 1; without labels of both
kinds every score is 0.0; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MAX_TRAIN, MAX_TRAIN_CHARS, LANDMARKS, POSITIVE, NEGATIVE, ROUNDS = 2000, 20_000, 768, 2500, 4000, 4
WINDOW, STRIDE, ORDER, SPAN, DECAY, SHARE, BITS = 12, 4, 4, 6, 0.6, 0.25, 18
LEVELS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
MEMO = 300_000
WEIGH = 2.2
#: Digits and signs that stand in for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
INNER = re.compile(r"(?<=\S)[.*_\-'|+~^](?=\S)")
EDGE = re.compile(r"[^\w\s@$!]+|[!?.,;:]+(?=\s|\Z)", re.U)
SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|\n+")


def _folded() -> dict[int, str]:
    out = {}
    for c in range(0x24F):
        plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if chr(c).isalpha():
            out[c] = plain if len(plain) == 1 else chr(c)
    return out | {ord(k): v for k, v in LOOKALIKE.items()}


FOLD = _folded()


def _units(words: list[str]) -> list[str]:
    """Folded words of three letters or more, in order, the joined runs of single letters last."""
    out = [w for w in words if len(w) >= 3]
    if len(out) < len(words):
        run: list[str] = []
        for w in [*words, "--"]:
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) >= 4:
                out.append("".join(run))
            run = []
    return out


def sentences(text: str) -> list[list[str]]:
    """The distinct units of each sentence that has any. A text is folded as a whole, its sentences parted by a mark that
    counts as white space."""
    folded = EDGE.sub(" ", INNER.sub("", SENTENCE.sub("\x1f", text))).translate(FOLD)
    return [list(dict.fromkeys(us)) for s in folded.split("\x1f") if (us := _units(s.split()))]


def windows(unit: str) -> list[str]:
    """The unit between edge marks, in overlapping windows."""
    unit = f"^{unit}$"
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW + STRIDE, STRIDE)]


_PLACES = np.array([(i, *(i + x for x in c)) for i in range(WINDOW - ORDER + 1) for c in itertools.combinations(range(1, min(SPAN, WINDOW - i)), ORDER - 1)])
#: By length of a window, the normalised weights of its subsequences.
_WEIGHT = np.where(_PLACES[:, -1] < np.arange(WINDOW + 1)[:, None], DECAY ** (_PLACES[:, -1] - _PLACES[:, 0] + 1.0), 0.0)
_WEIGHT = (_WEIGHT / np.maximum(np.sqrt((_WEIGHT**2).sum(1, keepdims=True)), 1e-9)).astype("float32")


def grams(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the subsequences of each window, and the windows' lengths."""
    n = np.fromiter(map(len, rows), "int64", len(rows))
    flat = np.frombuffer("".join(r.ljust(WINDOW, "\0") for r in rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WINDOW)
    out = np.empty((len(rows), len(_PLACES)), "int32")
    for i in range(0, len(rows), 4096):
        h = np.uint64(0)
        for k in range(ORDER):
            h = (h ^ flat[i : i + 4096, _PLACES[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[i : i + 4096] = h >> np.uint64(64 - BITS)
    return out, n


class Units:
    """The distinct units of some sentences, as windows."""

    def __init__(self, us: list[str]):
        rows, at = [], [0]
        for u in us:
            rows += windows(u)
            at.append(len(rows))
        self.at, self.scale = np.array(at[:-1]), np.sqrt(np.diff(at))
        self.code, self.size = grams(rows) if rows else (np.zeros((0, len(_PLACES)), "int32"), np.zeros(0, "int64"))

    def values(self, weights: np.ndarray) -> np.ndarray:
        """The sum of weights over the features of each unit."""
        if not len(self.at):
            return np.zeros(0, "float32")
        parts = [(weights[self.code[i : i + 4096]] * _WEIGHT[self.size[i : i + 4096]]).sum(1) for i in range(0, len(self.code), 4096)]
        return np.add.reduceat(np.concatenate(parts), self.at) / self.scale

    def spread(self, out: np.ndarray, some: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Adds the features of some units, so much of each, to ``out``; which features these are."""
        end = np.append(self.at[1:], len(self.code))
        rows = np.concatenate([np.arange(self.at[u], end[u]) for u in some])
        share = np.repeat(shares / self.scale[some], end[some] - self.at[some])
        np.add.at(out, self.code[rows], (_WEIGHT[self.size[rows]] * share[:, None]).astype("float32"))
        return self.code[rows]


class Model:
    """Folded weights, intercept and the logistic regression over ``summary``."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.bias, self.curve = weights, bias, curve
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "curve": self.curve, "memo": {}}

    def learn(self, us: set[str]) -> None:
        """Remembers the values of units."""
        new = list(us - self.memo.keys())
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(us)
        for i in range(0, len(new), 20_000):
            self.memo.update(zip(new[i : i + 20_000], Units(new[i : i + 20_000]).values(self.weights).tolist()))

    def sentence(self, us: list[str]) -> float:
        return sum(map(self.memo.__getitem__, us)) / len(us) ** SHARE + self.bias

    def summary(self, said: list[list[str]]) -> np.ndarray:
        """What a document's sentences amount to; the first entry is 1."""
        whole = np.sort(np.array([self.sentence(us) for us in said] + [-2.0] * 3).clip(-2, 4))[:-4:-1]
        every = dict.fromkeys(itertools.chain.from_iterable(said))
        v = np.sort(np.array([self.memo[u] for u in every] + [-1.0] * 3).clip(-1, 8))[::-1]
        n = math.log1p(len(v) - 3)
        above = np.log1p(np.searchsorted(-v, [-x for x in LEVELS]))
        return np.array([1.0, *whole, *v[:3], *above, n, *(above * n), n * whole[0], n * v[0]])

    def score(self, said: list[list[str]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(said) @ self.curve, -30, 30))))


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on its active set; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype("float32")
    c = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x @ w.astype("float32")) < 1
        a = x[on]
        new = np.linalg.solve(ridge + (a * c[on, None].astype("float32")).T @ a, a.T @ (c[on] * y[on]))
        if np.allclose(new, w, atol=1e-4):
            break
        w = new
    return w[:-1], float(w[-1])


class Sentences:
    """Sentences of labelled documents as numbers of units."""

    def __init__(self, rows: Iterable[tuple[str, int]]):
        number: dict[str, int] = {}
        flat, at, doc, label = [], [0], [], []
        for i, (text, y) in enumerate(rows):
            label.append(y)
            for us in sentences(text):
                flat.append(np.fromiter((number.setdefault(u, len(number)) for u in us), "int32", len(us)))
                at.append(at[-1] + len(us))
                doc.append(i)
        self.units, self.label = list(number), np.array(label, "int64")
        self.flat = np.concatenate(flat) if flat else np.zeros(0, "int32")
        self.at, self.doc = np.array(at), np.array(doc, "int64")
        self.size = np.diff(self.at)

    def of(self, s: int) -> np.ndarray:
        return self.flat[self.at[s] : self.at[s + 1]]

    def values(self, model: Model) -> np.ndarray:
        v = np.concatenate([Units(self.units[i : i + 20_000]).values(model.weights) for i in range(0, len(self.units), 20_000)])
        return np.add.reduceat(v[self.flat], self.at[:-1]) / self.size**SHARE + model.bias


def _fitted(s: Sentences, good: np.ndarray, bad: np.ndarray, marks: np.ndarray) -> Model:
    """The machine on the Nystroem features of sentences of both labels; ``marks`` are landmarks among them."""
    rows = np.concatenate([good, bad])
    y = np.repeat([1.0, -1.0], [len(good), len(bad)])
    some = np.unique(np.concatenate([s.of(r) for r in rows]))
    us, dense = Units([s.units[u] for u in some]), np.zeros(1 << BITS, "float32")
    inner = [np.searchsorted(some, s.of(r)) for r in rows]
    flat, at = np.concatenate(inner), np.cumsum([0, *map(len, inner)])[:-1]
    power = s.size[rows] ** SHARE
    x = np.empty((len(rows), len(marks)), "float32")
    for k, m in enumerate(marks):
        hit = us.spread(dense, inner[m], np.full(len(inner[m]), 1 / power[m]))
        x[:, k] = np.add.reduceat(us.values(dense)[flat], at) / power
        dense[hit] = 0
    gram = x[marks].astype("float64")
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    keep = val > 1e-4 * val.max()
    fold = vec[:, keep] / np.sqrt(val[keep])
    w, bias = _machine(x @ fold.astype("float32"), y)
    for m, c in zip(marks, fold @ w):
        us.spread(dense, inner[m], np.full(len(inner[m]), c / power[m]))
    return Model(dense, float(bias), np.zeros(1))


def train(rows: Iterable[tuple[str, int]], share: float | None = None, landmarks: int = LANDMARKS) -> Model | None:
    """Fits the model on (text, label) rows; None without examples of both labels. share: of label 1 among all labels."""
    s = Sentences(rows)
    toxic = s.label[s.doc] == 1 if len(s.doc) else np.zeros(0, bool)
    good, bad = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(7)
    every_bad, sample = bad, lambda x, n: x[rng.permutation(len(x))[:n]]
    good, bad = sample(good, POSITIVE), sample(every_bad, NEGATIVE)
    for again in range(ROUNDS):
        # a third of the landmarks will do until the last round
        most = landmarks // (1 if again == ROUNDS - 1 else 3)
        marks = np.r_[sample(np.arange(len(good)), 3 * most // 4), len(good) + sample(np.arange(len(bad)), most // 4)]
        model = _fitted(s, good, bad, marks)
        if again < ROUNDS - 1:
            v = s.values(model)
            order = np.lexsort((v, s.doc))
            top = order[np.append(s.doc[order][1:] != s.doc[order][:-1], True)]
            top = top[toxic[top]]
            sure = np.setdiff1d(np.flatnonzero(toxic & (v > 0.5)), top)
            good = np.r_[sample(top, POSITIVE), sample(sure, max(0, POSITIVE - len(top)))]
            hard = every_bad[np.argsort(-v[every_bad], kind="stable")[: NEGATIVE // 2]]
            bad = np.union1d(sample(every_bad, NEGATIVE), hard)
    n1, n0 = int((s.label == 1).sum()), int((s.label == 0).sum())
    share = n1 / (n0 + n1) if share is None else min(0.9, max(0.02, share))
    ends = np.searchsorted(s.doc, np.arange(len(s.label) + 1))
    x = []
    for a, b in zip(ends, ends[1:]):
        said = [[s.units[u] for u in s.of(r)] for r in range(a, b)]
        model.learn(set(itertools.chain.from_iterable(said)))
        x.append(model.summary(said))
    x, y = np.array(x), s.label.astype(float)
    # the labels' own shares, but an example of label 1 counts ``WEIGH`` times
    weight = np.where(y > 0, WEIGH * share / n1, (1 - share) / n0) * len(y)
    b, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ b).clip(-30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ b)
    model.curve, model.memo = b, {}
    return model


def held_out_of(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[DataFrame, float | None]:
    """The bounded sample (doc_id, text, toxic): both labels' rows with the lowest hash of the id, none held out; and the
    share of label 1 among all labels that may be learned."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out_of(F.col("doc_id")))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.char_length("text") <= MAX_TRAIN_CHARS))
    # which ids: a narrow top-k; only their texts are then joined
    ids = known.join(rows.select("doc_id").distinct(), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    picked = ids.filter("toxic = 1").orderBy("h", "doc_id").limit(most).union(ids.filter("toxic = 0").orderBy("h", "doc_id").limit(most))
    return rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), known.agg(F.avg("toxic")).first()[0]


def fitted(sample: DataFrame, share: float | None) -> Model | None:
    """The model of the bounded sample, fitted in one task; the driver gets a table of 2^BITS weights."""

    def fit(batches):
        rows = sorted((int(i), t, int(y)) for pdf in batches for i, t, y in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]))
        model = train([(t, y) for _, t, y in rows], share)
        if model is not None:
            yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias], "curve": [model.curve.tolist()]})

    got = sample.select("doc_id", "text", "toxic").repartition(1).mapInPandas(fit, "weights binary, bias double, curve array<double>").collect()
    return Model(np.frombuffer(got[0].weights, "float32"), got[0].bias, np.array(got[0].curve)) if got else None


def score_of(model: Model | None):
    """A column function: struct (score, n_units) of a text column."""

    @F.pandas_udf("score double, n_units long")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple[float, int]] = []
        run: list[list[list[str]]] = []
        size = 0

        def flush():
            model.learn(set(itertools.chain.from_iterable(us for said in run for us in said)))
            rows.extend((model.score(said), sum(map(len, said))) for said in run)
            run.clear()

        for text in texts:
            said = sentences(text or "")
            if model is None:
                rows.append((0.0, sum(map(len, said))))
                continue
            run.append(said)
            size += sum(map(len, said))
            if size > 60_000:
                flush()
                size = 0
        if run:
            flush()
        return pd.DataFrame(rows, columns=["score", "n_units"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, held_out, score, predicted, n_units, one row per input row."""
    model = fitted(*training_rows(train_docs if train_docs is not None else docs, labels))
    out = docs.select(F.struct(*keep).alias("doc"), held_out_of(F.col("doc_id")).alias("held_out"), score_of(model)("text").alias("s"))
    predicted = (F.col("s.score") >= 0.5).cast("int").alias("predicted")
    return out.select(*[F.col("doc")[c].alias(c) for c in keep], "held_out", "s.score", predicted, "s.n_units")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    out = toxicity(docs.select(F.struct("*").alias("all"), "doc_id", "text"), labels, keep=("all",))
    return out.filter("predicted = 0").select("all.*")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
