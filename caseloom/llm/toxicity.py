"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the mean of vectors of its character n-grams (and of the whole word), found by hashing, so a misspelling
shares most vectors with the word it stands for.  A passage is the mean of its word vectors; a linear softmax over it
gives the probability of the toxic class.  Vectors and softmax are trained together in numpy by Adam.

Labels hold for documents while a few words decide, so training alternates: passages of a toxic document start as
positive, then only its best-scoring passages do; all passages of clean documents are negative.  A document's score is
that of its most toxic passage, put on a probability scale by a logistic fit on the training documents.

The training sample is bounded by ``SAMPLE`` documents of each class, drawn whatever their length; scoring reads every
whole text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.common import text_of
from caseloom.session import materialize

#: Bound of the training sample: documents of each class (whole texts), and passages drawn from a clean one.
SAMPLE, DRAWN = 500, 40
DIM, BUCKETS, PASSAGE, LONGEST_GRAM = 8, 1 << 18, 8, 6
#: Weight decay, which keeps the vectors of rare n-grams short, and the gradient below which steps shrink.
DECAY, FLOOR = 0.02, 1e-5
#: Texts scored together, whose new words are looked up in one go.
TOGETHER = 32
#: Model of this worker process.
LOADED: dict[str, Model] = {}
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\…“”„«»¿¡"


def in_test_fold(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def words(text: str) -> list[str]:
    return text.lower().split()


def grams(word: str) -> list[int]:
    """Buckets of a word and its n-grams of 3 to 6 characters, edges marked."""
    w = f"<{word.strip(_EDGE)}>"
    out = {w}
    for n in range(3, LONGEST_GRAM + 1):
        out.update(w[i:i + n] for i in range(len(w) - n + 1))
    return sorted(zlib.crc32(g.encode()) % BUCKETS for g in out)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()
#: First byte of a character of so many UTF-8 bytes, without its bits.
_LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)


def bags(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`grams` of many words at once: buckets, and the place of the word of each.

    The crc of all n-grams grows by one character a step, by the bytes of its UTF-8 form.
    """
    marked = [f"<{w.strip(_EDGE)}>" for w in ws]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(m) for m in marked])
    word = np.repeat(np.arange(len(ws)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(code))  # characters up to the word's end
    count = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    most, state = int(count.max()), np.full(len(code), 0xFFFFFFFF, np.uint32)
    if most > 1:
        rest = 6 * (count - 1).astype(np.uint32)  # bits after the first byte
        utf8 = [_LEAD[count] | code >> rest] + [0x80 | code >> (np.maximum(rest, 6 * b) - 6 * b) & 0x3F for b in range(1, most)]
    else:
        utf8 = [code]
    found, owner = [np.array([zlib.crc32(m.encode()) for m in marked], np.int64)], [np.arange(len(ws))]
    for n in range(1, LONGEST_GRAM + 1):
        state = state[:len(code) - n + 1]
        for b, byte in enumerate(utf8):
            grown = _CRC[(state ^ byte[n - 1:]) & 0xFF] ^ state >> 8
            state = np.where(count[n - 1:] > b, grown, state) if b else grown
        if n >= 3:
            at = np.nonzero(left[:len(state)] >= n)[0]
            found.append((~state[at]).astype(np.int64))
            owner.append(word[at])
    key = np.sort(np.concatenate(owner) << 32 | np.concatenate(found))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & BUCKETS - 1, key >> 32


class Model:
    """``E``: n-gram vectors; ``W``, ``b``: softmax; ``scale``: logistic map of the best passage's logit."""

    def __init__(self, E: np.ndarray, W: np.ndarray, b: np.ndarray, scale: tuple[float, float]):
        self.E, self.W, self.b, self.scale = E, W, b, scale
        self.side = W[:, 1] - W[:, 0]
        self.per_gram = np.einsum("gd,d->g", E, self.side)  # the mean is linear, so a word's vector is needed only through this product
        self.known: dict[str, float] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the values of words not met before."""
        if len(self.known) > 600_000:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            bucket, place = bags(part)
            self.known.update(zip(part, (np.bincount(place, self.per_gram[bucket]) / np.bincount(place)).tolist()))

    def word(self, w: str) -> float:
        self.learn([[w]])
        return self.known[w]

    def logits(self, texts: list[str]) -> list[float]:
        """Logit of the most toxic passage of each text."""
        split = [words(t) for t in texts]
        self.learn(split)
        known, bias, out = self.known, float(self.b[1] - self.b[0]), []
        for ws in split:
            v = np.array([known[w] for w in ws])
            if not len(v):
                out.append(bias)
            elif len(v) <= PASSAGE:
                out.append(bias + float(v.mean()))
            else:
                c = np.concatenate([[0.0], np.cumsum(v)])
                out.append(bias + float((c[PASSAGE:] - c[:-PASSAGE]).max()) / PASSAGE)
        return out

    def logit(self, text: str) -> float:
        return self.logits([text])[0]

    def scores(self, texts: list[str]) -> list[float]:
        a, c = self.scale
        return (1 / (1 + np.exp(-np.clip(a * np.array(self.logits(texts)) + c, -40, 40)))).tolist()

    def score(self, text: str) -> float:
        return self.scores([text])[0]


class _Adam:
    """Adam with weight decay."""

    def __init__(self, *params: np.ndarray, rate: float, decay: float):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m, self.v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.p, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p *= 1 - self.rate * self.decay
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + FLOOR)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _passages(ids: list[int], stride: int = PASSAGE // 2) -> list[list[int]]:
    return [ids[i:i + PASSAGE] for i in range(0, max(1, len(ids) - stride), stride) if ids[i:i + PASSAGE]]


def train(samples: list[tuple[str, int]], rounds: int = 5, steps: int = 10, seed: int = 0, drawn: int = DRAWN) -> Model:
    """Joint training on (text, label); without both classes every score is the base rate.

    Products of matrices are sums here: threads of matrix routines may hang in a process that runs Spark.
    """
    r = np.random.default_rng(seed)
    E, W, b = r.standard_normal((BUCKETS, DIM)) * 0.02, r.standard_normal((DIM, 2)) * 0.3, np.zeros(2)
    labels = np.array([y for _, y in samples], int)
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model(E, W * 0, b, (0.0, float(np.log((rate + 0.01) / (1.01 - rate)))))
    index: dict[str, int] = {}
    passages, owner = [], []
    for d, (text, y) in enumerate(samples):
        ws = words(text)
        cut = _passages(list(range(len(ws))))
        if not y and len(cut) > drawn:  # any passage of a clean text is clean
            cut = [cut[i] for i in np.sort(r.choice(len(cut), drawn, replace=False))]
        for part in cut:
            passages.append([index.setdefault(ws[i], len(index)) for i in part])
            owner.append(d)
    owner = np.array(owner)
    bags = [grams(w) for w in index]
    held, gram = np.unique(np.concatenate(bags), return_inverse=True)  # only the buckets at hand move
    gram_of = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    V0 = E[held]
    gram_share = (1 / np.bincount(gram_of))[gram_of][:, None]
    sizes = np.array([len(p) for p in passages])
    word, word_of = np.concatenate(passages), np.repeat(np.arange(len(passages)), sizes)
    starts, gram_starts = np.cumsum(sizes) - sizes, np.searchsorted(gram_of, np.arange(len(bags)))
    toxic = labels[owner] == 1
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    descent = _Adam(V0, W, b, rate=0.05, decay=DECAY)

    def forward():
        V = np.add.reduceat(V0[gram] * gram_share, gram_starts)
        H = np.add.reduceat(V[word], starts) / sizes[:, None]
        Z = np.einsum("pd,dc->pc", H, W) + b
        Z -= Z.max(axis=1, keepdims=True)
        P = np.exp(Z)
        return H, P / P.sum(axis=1, keepdims=True), Z[:, 1] - Z[:, 0]

    for _ in range(rounds):
        for _ in range(steps):
            H, P, _z = forward()
            G = (P - np.stack([~toxic, toxic], axis=1)) * weight[:, None]
            dH = np.einsum("pc,dc->pd", G, W) / sizes[:, None]
            dV = _scatter(word, dH[word_of], len(bags))
            dE = _scatter(gram, dV[gram_of] * gram_share, len(held))
            descent.step(dE, np.einsum("pd,pc->dc", H, G), G.sum(axis=0))
        z = forward()[2]
        best = np.full(len(samples), -np.inf)
        np.maximum.at(best, owner, z)
        mine = labels[owner] == 1
        chosen = mine & (z >= best[owner] - 0.5)  # a toxic document's best passages
        hard = ~mine & (z >= best[owner] - 0.5)  # clean passages that look worst count twice over
        clean = 0.25 / max(1, (~mine).sum()) + hard * (0.25 / max(1, hard.sum()))
        weight = np.where(chosen, 0.5 / max(1, chosen.sum()), np.where(mine, 0.0, clean))
    E[:] = 0  # a bucket without a word of the sample says nothing
    E[held] = V0
    model = Model(E, W, b, (1.0, 0.0))
    x = np.array([model.logit(t) for t, _ in samples])
    mid, spread = float(x.mean()), float(x.std()) or 1.0
    u, a, c = (x - mid) / spread, 1.0, 0.0
    for _ in range(300):  # logistic fit of two numbers
        p = 1 / (1 + np.exp(-np.clip(a * u + c, -40, 40)))
        a -= 0.5 * (float(((p - labels) * u).mean()) + 0.002 * a)
        c -= 0.5 * float((p - labels).mean())
    return Model(E, W, b, (a / spread, c - a * mid / spread))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``per_class`` whole texts of each class from outside the test fold, in hash order of their ids.

    Ids are chosen from ``labels`` first, so one scan of the documents finds the texts.  Null labels and null ids are left
    out; a document with both labels counts as toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = materialize(picked[0].union(picked[1]), "toxicity-sample")  # at most twice ``per_class`` rows
    rows = docs.select("doc_id", text_of("text").alias("t")).join(F.broadcast(chosen), "doc_id").select("t", "y", order.alias("h")).distinct()
    return [(r.t, r.y) for r in sorted(rows.collect(), key=lambda r: (r.y, r.h, r.t))]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Null and empty texts get the score of no words.  Repeated rows score alike; other columns are not read; an empty
    table gives no rows.  A null id counts as not held out.
    """
    parts, name = docs.sparkSession.sparkContext.broadcast((model.E.astype(np.float32), model.W, model.b, model.scale)), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from caseloom.llm import toxicity as here  # the module of the worker process, whose tasks share words scored before

        if name not in here.LOADED:
            here.LOADED.clear()
            here.LOADED[name] = Model(*parts.value)
        scorer = here.LOADED[name]
        for b in batches:
            s = [x for i in range(0, len(b), TOGETHER) for x in scorer.scores(b.column("_t").slice(i, TOGETHER).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text_of("text").alias("_t")).mapInArrow(work, f"doc_id {kind}, score double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(training_sample(docs, labels)))
