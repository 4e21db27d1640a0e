"""Operator 9: document quality by gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
from its character-class bigrams and word statistics; gated attention weights,
learned from document labels alone, say how much a passage counts; the weighted
passage representation gives the score.  Neither labels nor language, source or
id enter a score.

Training: the labelled documents with the ``SAMPLE`` smallest id hashes among
those whose crc32(id as text) mod 3 is not 1, one row an id and at most
``FIT_PASSAGES`` passages of it.  So what reaches the driver is bounded; scoring runs over every passage of every text in Arrow batches.

Defined results
    null or blank text  a bag with one all-zero passage; it gets a score like any other
    very long texts     all passages, counted chunk by chunk
    no labels           nothing to learn from: every score is 0.5, so nothing is rejected
    several labels      of one id: the smallest
    null label, null id in labels  ignored
    null id             scored; not held out
    repeated rows       scored alike
    empty table         no rows
    extra columns       those named in ``keep`` are carried along
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import keeping, lean, table
from geolink.llm.textkernel import chunks, window_hashes, word_hashes, words

#: Words in a passage; most labelled documents that training reads; hidden and attention units; training steps.
PASSAGE, SAMPLE, HIDDEN, ATTENTION, STEPS = 100, 3_000, 16, 8, 250
#: Most passages of one document that training reads, spread evenly over it (scoring reads all).
FIT_PASSAGES = 64
#: Bytes of text whose passages are made at once; each takes some 60 bytes of arrays meanwhile.
PASSAGE_BYTES = 1 << 18
SEED = 7

#: Character classes: lower, upper, digit, blank, newline, non-ASCII, and the punctuation that junk is made of.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".", ",;:", "!?", "|", "*", "#", "$", "%", "&<>", "\"'()-"]
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
_K = len(_GROUPS) + 1
#: Passage features: class bigrams, then distinct words, word length, size; then of the document: repeated trigrams, size.
WIDTH = _K * _K + 5


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes in each group (44 bits of a hash tell values apart)."""
    key = np.sort((group.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def passages(column: pa.Array):
    """Yield (row, features float32 [passages, WIDTH]) for every text of a column, in order."""
    for lo, _, data, offsets in chunks(column, PASSAGE_BYTES):
        w = words(data, offsets)
        per = np.maximum(1, -(-w.counts // PASSAGE))  # passages of each text
        start = np.r_[0, np.cumsum(per)]
        total = int(start[-1])
        text = w.text_of
        own = start[text] + (np.arange(len(text)) - w.first[text]) // PASSAGE  # passage of each word
        out = np.zeros((total, WIDTH), dtype=np.float32)
        if len(text):
            # a byte belongs to the passage of the word it is in or follows; blanks before a text's first word to none
            head = np.r_[True, own[1:] != own[:-1]]
            spans = np.r_[w.starts[head], len(data)]
            of_byte = np.repeat(own[head], np.diff(spans))
            kind = _CLASS[data[spans[0] :]]
            # pairs lie within one text, so a score doesn't depend on the texts beside it
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(edge, offsets[:-1], 1)
            np.add.at(edge, np.where(w.counts > 0, w.starts[np.minimum(w.first[:-1], len(w.starts) - 1)], offsets[1:]), -1)
            solid = np.cumsum(edge[:-1]) == 0
            ends = offsets[1:]
            solid[ends[ends > 0] - 1] = False
            solid = solid[spans[0] : -1]
            pair = (kind[:-1] * _K + kind[1:])[solid]
            counts = np.bincount(of_byte[:-1][solid] * (_K * _K) + pair, minlength=total * _K * _K)[: total * _K * _K].reshape(total, -1)
            out[:, : _K * _K] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
            h = word_hashes(w)
            size = np.bincount(own, minlength=total)
            safe = np.maximum(1, size)
            out[:, -5] = _distinct(own, h, total) / safe
            out[:, -4] = np.bincount(own, weights=w.ends - w.starts, minlength=total) / safe / 10
            out[:, -3] = np.log1p(size)
            grams = window_hashes(h, 3)
            inside = np.arange(len(grams)) + 3 <= w.first[text[: len(grams)] + 1]
            n = np.bincount(text[: len(grams)][inside], minlength=len(per))
            once = _distinct(text[: len(grams)][inside], grams[inside], len(per))
            out[:, -2] = np.repeat((n - once) / np.maximum(1, n), per)  # no trigram, none repeated
            out[:, -1] = np.repeat(np.log1p(w.counts) / 10, per)
        for i in range(len(per)):
            yield lo + i, out[start[i] : start[i + 1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of encoder (w, b), gated attention (v, u, a) and output (c, d), and the input scaling."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    attend: bool = True

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: scaled passages of all bags; ``first``: each bag's first passage."""
        p = self.weights
        sizes = np.diff(np.r_[first, len(x)])
        bag = np.repeat(np.arange(len(first)), sizes)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        s = (t * g) @ p["a"] * self.attend
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        first = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]].astype(np.int64)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return np.asarray(self.forward(x, first)["score"], dtype=np.float64)


def train(bags: list[np.ndarray], labels: np.ndarray, *, steps: int = STEPS, rate: float = 0.01, decay: float = 1e-3, seed: int = SEED, attend: bool = True) -> Model:
    """Fit all weights by Adam on the documents' cross-entropy, the rarer class weighted up to twofold.

    Without ``attend`` all passages weigh alike: for comparison only.
    """
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(np.float32)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    first = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]].astype(np.int64)
    shapes = {"w": (x.shape[1], HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": ()}
    p = {k: (rng.normal(0, 1, s) / np.sqrt(s[0] if s else 1) * (k not in "bd")).astype(np.float32) for k, s in shapes.items()}
    model = Model(mean, scale, p, attend)
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    y = labels.astype(np.float32)
    rare = min(2.0, (1 - y.mean()) / max(y.mean(), 1e-6)) if y.mean() < 0.5 else min(2.0, y.mean() / max(1 - y.mean(), 1e-6))
    weight = np.where((y == 1) == (y.mean() < 0.5), rare, 1.0).astype(np.float32)
    weight /= weight.sum()
    for step in range(1, steps + 1):
        f = model.forward(x, first)
        bag, h, t, g, alpha = f["bag"], f["h"], f["t"], f["g"], f["alpha"]
        do = (f["score"] - y) * weight
        dz = do[:, None] * p["c"]
        dalpha = (dz[bag] * h).sum(axis=1)
        ds = attend * alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        dtg = ds[:, None] * p["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (alpha[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        grad = {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": f["z"].T @ do, "d": do.sum()}
        for k, q in p.items():
            d = grad[k] + decay * q * (k not in "bd")
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] = (q - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> pa.Table:
    """(doc_id, y, bag) of the documents to learn from, in the order of ids."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null").where(_fold("_id") != 1)
    chosen = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # of several rows of one id the smallest text by hash, picked with partial aggregation
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "_y")).alias("r")).select("doc_id", "r.text", "r._y")

    def read(batches):
        for batch in batches:
            body = [f[np.linspace(0, len(f) - 1, min(len(f), FIT_PASSAGES)).astype(int)].astype("<f2").tobytes() for _, f in passages(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("_y").cast(pa.int32()), pa.array(body, pa.binary())], names=["doc_id", "y", "bag"])

    return rows.mapInArrow(lean(read), "doc_id long, y int, bag binary").toArrow().sort_by([("doc_id", "ascending"), ("bag", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents outside the held-out third, ``sample`` of them at most."""
    got = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    if not len(got):
        blank = train([np.zeros((1, WIDTH), np.float32)] * 2, np.array([0, 1]), steps=0)
        blank.weights["c"] = np.zeros_like(blank.weights["c"])
        return blank
    bags = [np.frombuffer(b.as_buffer(), "<f2").reshape(-1, WIDTH).astype(np.float32) for b in got["bag"]]
    return train(bags, got["y"].to_numpy())


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``keep`` for every row."""
    kept = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType.typeName() == "string" else None
    return _score(docs, model, id_col, text_col, kept, keep=keep)


@keeping
def _score(docs: DataFrame, model: Model, id_col: str, text_col: str, kept: int | None, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``kept``: the place of the text in ``keep``; then it goes to the workers once."""
    text = "_text" if kept is None else keep[kept]
    own = [F.col(text_col).cast("string").alias("_text")] if kept is None else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *own, (_fold(id_col) == 1).alias("held_out"), *keep)
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])

    def read(batches):
        for batch in batches:
            out, held, n = [], [], 0
            for _, bag in passages(batch.column(text)):
                held.append(bag)
                n += len(bag)
                if n >= 4096:
                    out.append(model.score(held))
                    held, n = [], 0
            if held:
                out.append(model.score(held))
            made = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(made, pa.float64())], names=[*(f.name for f in fields), "score"])

    scored = rows.mapInArrow(lean(read), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
