"""Quality classifier: gated attention over a document's passages (multiple-instance learning).

A document is a bag of passages of PASSAGE words.  A passage's learned encoding has two layers: embeddings of hashed
words and word ends, pooled over the passage, together with surface statistics give a hidden layer g, and that gives
h.  The attention weight is softmax(w . (tanh(V h) * sigmoid(U h))), the document's score a logistic of the weighted
mean of h.  Only documents carry labels; embeddings, layers and attention are learned from those.

Learning uses at most SAMPLE labelled ids (those with the least hash among the training folds), one row of each (that
of the least features), and at most FIT_PASSAGES passages of a row, evenly spread, in numpy on the driver; scoring runs
over all rows and passages, map-side.  The id decides folds and the sample and is never part of a score, nor are
labels, lang or source.

Null and empty texts are one passage without words and are scored like any other; repeated rows score alike; an id
with several labels counts with the greatest.  Without labelled rows, or with one class alone, the score is the share
of label 1 (0.5 without any).  An empty table gives an empty result.  Other columns are carried along as they are;
the caller names the score's column.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import portions

PASSAGE = 64
#: Most labelled rows that the model is fitted to.
SAMPLE = 4000
#: Most passages of a row that the model is fitted to.
FIT_PASSAGES = 64
HASHED, ENDS = 96, 32
WORDS, HIDDEN, ATTENTION = 24, 16, 8
EPOCHS, RATE, DECAY, SEED = 60, 0.02, 1e-3, 7
THRESHOLD = 0.3
FOLDS = 5

_SYMBOLS = b"#*$%&|<>{}[]\\^~=+_@"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS, _HIGH = b".,;:!?'\"()-/", bytes(range(128, 256))
N_SURFACE = 13
N_FEATURES = N_SURFACE + HASHED + ENDS


def passages(text: str) -> np.ndarray:
    """One row of features for each passage of the whole text."""
    words = text.encode().split()
    seen: set[bytes] = set()
    out = np.zeros((max(1, -(-len(words) // PASSAGE)), N_FEATURES), np.float32)
    for k in range(0, len(words), PASSAGE):
        part = words[k : k + PASSAGE]
        n, line, own = len(part), b" ".join(part), set(part)
        size = len(line)
        without = lambda drop: (size - len(line.translate(None, drop))) / size  # noqa: E731, B023
        row = out[k // PASSAGE]
        row[:13] = (
            n / PASSAGE,
            (size + 1) / n - 1,
            len(own) / n,
            len(set(zip(part, part[1:], strict=False))) / n,
            len(own & seen) / n,
            without(_SYMBOLS),
            without(_UPPER),
            without(_DIGITS),
            without(_MARKS),
            without(_HIGH),
            max(map(len, part)) / 32,
            sum(w[-1:] in b".!?" for w in part) / n,
            line.count(b"!!") / n,
        )
        row[N_SURFACE : N_SURFACE + HASHED] = np.bincount([zlib.crc32(w) % HASHED for w in part], minlength=HASHED) / n
        row[N_SURFACE + HASHED :] = np.bincount([zlib.crc32(w[-2:]) % ENDS for w in part], minlength=ENDS) / n
        seen |= own
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray):
        w = self.weights
        g = np.tanh(((x - self.mean) / self.scale).astype(np.float64) @ w["E"] + w["e"])
        h = np.tanh(g @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["w"]
        sizes = np.diff(np.r_[starts, len(x)])
        bag = np.repeat(np.arange(len(starts)), sizes)
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return g, h, t, s, a, bag, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant or 0.0)
        sizes = np.array([len(b) for b in bags])
        return self.forward(np.concatenate(bags), np.cumsum(sizes) - sizes)[-1]

    def attention(self, bag: np.ndarray) -> np.ndarray:
        return self.forward(bag, np.array([0]))[4]


def _gradient(model: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w = model.weights
    g, h, t, s, a, bag, z, p = model.forward(x, starts)
    ds = (p - y) / len(y)
    dz = ds[:, None] * w["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dg = de[:, None] * w["w"]
    dt, du = dg * s * (1 - t**2), dg * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    dg1 = dh @ w["W"].T * (1 - g**2)
    out = {"E": ((x - model.mean) / model.scale).T @ dg1, "e": dg1.sum(0), "W": g.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * s).T @ de, "c": z.T @ ds, "c0": ds.sum()}
    return {k: v + DECAY * w[k] for k, v in out.items()}


def fit(bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Adam over mini-batches of documents, in a fixed order."""
    rng = np.random.default_rng(SEED)
    flat = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES), np.float32)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"E": init(N_FEATURES, WORDS), "e": np.zeros(WORDS), "W": init(WORDS, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "c0": np.zeros(())}
    model = Model(flat.mean(0), np.maximum(flat.std(0), 1e-3), weights)
    if len(set(y.tolist())) < 2:
        model.constant = float(y[0]) if len(y) else 0.5
        return model
    first, second, step = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for part in np.array_split(order, max(1, len(bags) // 256)):
            own = [bags[i] for i in part]
            sizes = np.array([len(b) for b in own])
            grad, step = _gradient(model, np.concatenate(own), np.cumsum(sizes) - sizes, y[part]), step + 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of labels.quality, from at most SAMPLE labelled documents outside the held-out fold."""
    chosen = labels.select("doc_id", "quality").filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))  # SAMPLE rows of two numbers

    def run(batches):
        for batch in batches:
            bags = []
            for a, n in portions(batch.column(2), 256):
                for t in batch.column(2).slice(a, n).to_pylist():
                    bag = passages(t or "")
                    bags.append(bag[np.linspace(0, len(bag) - 1, min(len(bag), FIT_PASSAGES)).astype(int)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])

    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    found = labelled.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, bag binary")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("quality", "bag")).alias("x")).select("doc_id", "x.*").collect()  # SAMPLE rows of FIT_PASSAGES passages
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows], np.array([r["quality"] for r in rows], float))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a last column of that name."""
    from pyspark.sql import types as T

    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = [np.empty(0)]
            for k, n in portions(batch.column(at), 128, 1 << 20):
                scores.append(model.score([passages(t or "") for t in batch.column(at).slice(k, n).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op4_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
