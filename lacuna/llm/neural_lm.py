"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-cased words and one end per text.  The model's symbols are the end, the VOCABULARY most frequent
training words and CLASSES classes of all other words (by their last two bytes).  Within a class, unseen words are
one outcome, as they are in the base score, with the Good-Turing share (words seen once / tokens); a seen word has
its part of the rest.

A symbol's probability given the CONTEXT symbols before it is that of its group times that within the group, both
learned: softmax(S q + t) over GROUPS groups, softmax(R q + b) over the group's symbols, with q = sum of c_i * e_i over
the context.  Groups hold equally many symbols that follow the same COMPANY frequent symbols.  Both softmaxes are
normalised by batched matrix products, so a token costs GROUPS + symbols / GROUPS products, not one for each symbol.

1. One pass cuts every text into indices of a dictionary of its block (at most BLOCK_TOKENS tokens of one task).
2. The dictionaries, not the tokens, are shuffled: training counts are summed by word and sent back to the blocks.
3. Every document becomes its symbols, its base score and its words' shares within classes.
4. One pass counts what follows frequent symbols; from these counts the symbols are grouped.
5. Training rows are dealt by hash into shards of about SHARD_TOKENS and within them to TURNS, so neither the order of
   rows nor the layout of files matters.  In a turn each shard trains on from the common parameters on that turn's rows,
   by noise-contrastive estimation of both softmaxes.  Spark then joins the moves of all shards to one model, from which
   the next turn starts: a row of parameters moves by the mean of its moves, weighted by the squared gradients that it
   met in each shard, so a word that one shard alone holds isn't held back by the others.  All turns are one pass.
6. One pass scores every row.

Null text counts as empty: one end.  Rows are scored one by one, so repeated ids and rows are fine, and texts of any
length are scored whole.  Without training rows all counts are zero and the model is uniform; an empty table gives an
empty result.  Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from math import log10

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import new_folder, portions, to_table

VOCABULARY = 16_384
CLASSES = 256
GROUPS = 128
#: The end and the most frequent words, whose followers decide the groups.
COMPANY = 64
CONTEXT = 3
DIM = 24
#: Noise samples for the group of a token, and within it.
NOISE = 32
BATCH = 16_384
#: Tokens of one group that share noise samples.
TOGETHER = 32
RATE = 0.2
#: Parts of the pass over all training tokens; the shards' models become one after each.
TURNS = 8
SHARD_TOKENS = 4_000_000
BLOCK_TOKENS = 3_000_000
FOLDS, HELD_OUT = 7, 2
SEED = 11
#: The end of a text; no word holds white space.
END = "\n"
N_SYMBOLS = 1 + VOCABULARY + CLASSES
#: Places of a group; the last ones of some groups stay empty.
WIDTH = -(-N_SYMBOLS // GROUPS)
SLOTS = GROUPS * WIDTH


def squeezed(numbers: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers take hardly any room."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes())


def expanded(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def rounded(numbers: np.ndarray) -> bytes:
    """float32 to 8 binary digits: the upper halves."""
    return squeezed(((numbers.view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16))


def widened(data: bytes) -> np.ndarray:
    return (expanded(data, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def class_of(word: str) -> int:
    return zlib.crc32(word.encode()[-2:]) % CLASSES


def shares(n: int, once: int) -> tuple[float, float]:
    """log10 of a class's share for unseen words, and of what one token of a seen word adds to its word's share."""
    unseen = (once + 1) / (n + 2) if n else 1.0
    return log10(unseen), log10((1 - unseen) / n) if n else 0.0


# --- the model -----------------------------------------------------------------------------------------------


def grouped(company: np.ndarray) -> np.ndarray:
    """Slot (group * WIDTH + place) of each symbol, from counts (COMPANY x symbols): halved again and again across the direction in which the followed symbols differ most."""
    expected = company.sum(1, keepdims=True) * (company.sum(0, keepdims=True) / max(1, company.sum()))
    x = np.log((company + 1.0) / (expected + 1.0)).T
    parts = [np.arange(company.shape[1])]
    while len(parts) < GROUPS:
        halves = []
        for own in parts:
            y = x[own] - x[own].mean(0)
            direction = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = own[np.argsort(np.round(y @ direction, 6) * (1 if direction[np.abs(direction).argmax()] > 0 else -1), kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    slot = np.empty(company.shape[1], np.int64)
    for g, own in enumerate(parts):
        slot[own] = g * WIDTH + np.arange(len(own))
    return slot


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / inf is 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp along the last axis."""
    top = max(0.0, float(x.max(initial=0)) - 80)  # of no use in a trained model, but nothing may overflow
    if top:
        x -= top
    return np.log(np.exp(x, out=x) @ np.ones(x.shape[-1], x.dtype)) + top


def _summed_by(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, sorted, and the sums of their rows."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index = index.take(order)
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index.take(first), np.add.reduceat(rows.take(order, axis=0), first)


class LogBilinear:
    """Parameters as one vector: E and R (slots x DIM), b (slots), S (groups x DIM), t (groups), c (CONTEXT x DIM).

    AdaGrad keeps one sum for each row of a matrix, of the mean squares of its gradients.
    """

    SHAPES = {"E": (SLOTS, DIM), "R": (SLOTS, DIM), "b": (SLOTS,), "S": (GROUPS, DIM), "t": (GROUPS,), "c": (CONTEXT, DIM)}
    SIZE = sum(int(np.prod(x)) for x in SHAPES.values())
    #: How many parameters share each of AdaGrad's sums, one after the other.
    SHARED = np.concatenate([np.full(x[0], int(np.prod(x[1:]))) for x in SHAPES.values()])

    def __init__(self, counts: np.ndarray, state: np.ndarray | None = None):
        """counts: of training tokens by slot, -1 for empty places.  state: the parameters and AdaGrad's sums."""
        filled = counts >= 0
        own = np.where(filled, counts + 1.0, 0.0).reshape(GROUPS, WIDTH)
        self.groups = own.sum(1) / own.sum()
        self.within = own / own.sum(1, keepdims=True)
        if state is None:
            rng = np.random.default_rng(SEED)
            with np.errstate(divide="ignore"):
                b = np.maximum(np.log(self.within), -1e4)
            first = {"E": rng.normal(0, 0.3, (SLOTS, DIM)), "R": np.zeros((SLOTS, DIM)), "b": b, "S": np.zeros((GROUPS, DIM)), "t": np.log(self.groups), "c": np.outer(1 / np.arange(1, CONTEXT + 1), np.ones(DIM))}
            state = np.concatenate([*(np.ravel(first[k]) for k in self.SHAPES), np.ones(len(self.SHARED))])
        self.state, at, row = np.array(state, np.float32), 0, self.SIZE
        self.sums: dict[str, np.ndarray] = {}
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.state[at : at + n].reshape(shape))
            self.sums[name] = self.state[row : row + shape[0]].reshape(shape[0], *(1,) * (len(shape) - 1))
            at, row = at + n, row + shape[0]
        self.log_groups = np.log(NOISE * self.groups).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.log_within = np.maximum(np.log(NOISE * self.within), -1e4).ravel().astype(np.float32)
        self.drawing = (np.arange(GROUPS)[:, None] + np.minimum(np.cumsum(self.within, axis=1), 1)).ravel()

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        q = self.E.take(contexts[:, 0], axis=0)
        q *= self.c[0]
        for i in range(1, CONTEXT):
            part = self.E.take(contexts[:, i], axis=0)
            part *= self.c[i]
            q += part
        return q

    @staticmethod
    def blocks(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each block, rows of each block): at most TOGETHER rows of one group, filled up with -1."""
        order, n = np.argsort(groups, kind="stable"), np.bincount(groups, minlength=GROUPS)
        many = -(-n // TOGETHER)
        at = np.arange(len(groups)) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(many) - many) * TOGETHER, n)
        rows = np.full(int(many.sum()) * TOGETHER, -1, np.int64)
        rows[at] = order
        return np.repeat(np.arange(GROUPS), many), rows.reshape(-1, TOGETHER)

    def log_probabilities(self, contexts: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all symbols."""
        out = np.empty(len(slots))
        # biases as one more column, against a column of ones
        S = np.concatenate([self.S.T, self.t[None]])
        R = np.ascontiguousarray(np.concatenate([self.R.reshape(GROUPS, WIDTH, DIM), self.b.reshape(GROUPS, WIDTH, 1)], 2))
        for k in range(0, len(slots), 1 << 14):
            w = slots[k : k + (1 << 14)]
            q, g = np.ones((len(w), DIM + 1), np.float32), w // WIDTH
            q[:, :DIM] = self.predicted(contexts[k : k + len(w)])
            s = q @ S
            value = s[np.arange(len(w)), g] + np.einsum("ij,ij->i", q, R.reshape(SLOTS, -1).take(w, axis=0))
            value -= _log_sum(s)
            of_block, rows = self.blocks(g)
            flat = rows.ravel()
            norm = _log_sum(q.take(flat, axis=0, mode="wrap").reshape(*rows.shape, -1) @ R.take(of_block, axis=0).transpose(0, 2, 1)).ravel()
            kept = np.flatnonzero(flat >= 0)
            value[flat.take(kept)] -= norm.take(kept)
            out[k : k + len(w)] = value
        return out

    def _moved(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        gradient = gradient.astype(np.float32, copy=False)
        squares = gradient * gradient if gradient.ndim == 1 else np.einsum("ij,ij->i", gradient, gradient)[:, None] / np.float32(DIM)
        sums = self.sums[name][rows] + squares
        self.sums[name][rows] = sums
        np.sqrt(sums, out=sums)
        gradient = RATE * gradient
        gradient /= sums
        getattr(self, name)[rows] -= gradient

    def moves(self, start: np.ndarray) -> np.ndarray:
        """What joined() adds up: the moves since start, times what each row's sum grew by, and these growths."""
        out = self.state - start
        out[: self.SIZE] *= np.repeat(out[self.SIZE :], self.SHARED)
        return out

    @classmethod
    def joined(cls, start: np.ndarray, added: np.ndarray, models: int) -> np.ndarray:
        """State after a turn, from the sum of the moves of so many models."""
        grown = np.repeat(added[cls.SIZE :], cls.SHARED)
        moved = np.divide(added[: cls.SIZE], grown, out=np.zeros(cls.SIZE), where=grown > 0)
        return (start + np.concatenate([moved, added[cls.SIZE :] / models])).astype(np.float32)

    def step(self, contexts: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        """Noise-contrastive estimation of both softmaxes on one batch, by AdaGrad; noise comes from the unigram distributions."""
        q, g = self.predicted(contexts), w // WIDTH
        of_block, rows = self.blocks(g)
        real, flat = rows >= 0, rows.ravel()
        qb = q.take(flat, axis=0, mode="wrap").reshape(*rows.shape, DIM)
        # groups: one data sample and NOISE samples for the whole batch
        z = rng.choice(GROUPS, NOISE, p=self.groups)
        Sz = self.S[z]
        weight = _sigmoid(q @ Sz.T + (self.t[z] - self.log_groups[z]))
        own = _sigmoid(np.einsum("ij,ij->i", q, self.S.take(g, axis=0)) + self.t.take(g) - self.log_groups.take(g)) - 1
        dq = weight @ Sz
        dq += own[:, None] * self.S.take(g, axis=0)
        gS, gt = np.zeros_like(self.S), np.bincount(g, own, GROUPS)
        np.add.at(gS, of_block, ((own.take(flat, mode="wrap").reshape(rows.shape) * real)[:, None, :] @ qb)[:, 0, :])
        np.add.at(gS, z, weight.T @ q)
        np.add.at(gt, z, weight.sum(0))
        # within groups: NOISE samples for each block
        Rw = self.R.take(w, axis=0)
        data = _sigmoid(np.einsum("ij,ij->i", q, Rw) + self.b.take(w) - self.log_within.take(w)) - 1
        dq += data[:, None] * Rw
        noise = np.minimum(np.searchsorted(self.drawing, of_block[:, None] + rng.random((len(rows), NOISE))), SLOTS - 1)
        Rn = self.R.take(noise.ravel(), axis=0).reshape(*noise.shape, DIM)
        d = _sigmoid(qb @ Rn.transpose(0, 2, 1) + (self.b - self.log_within).take(noise)[:, None, :])
        d *= real[:, :, None]
        kept = np.flatnonzero(flat >= 0)
        back = np.empty_like(dq)
        back[flat.take(kept)] = (d @ Rn).reshape(-1, DIM).take(kept, axis=0)
        dq += back
        moves = np.empty((len(w) + noise.size, DIM + 1), np.float32)
        np.multiply(data[:, None], q, out=moves[: len(w), :DIM])
        moves[: len(w), DIM] = data
        moves[len(w) :, :DIM] = (d.transpose(0, 2, 1) @ qb).reshape(-1, DIM)
        moves[len(w) :, DIM] = d.sum(1).ravel()
        symbols, moves = _summed_by(np.concatenate([w, noise.ravel()]), moves)
        gc = np.stack([np.einsum("ij,ij->j", dq, self.E.take(contexts[:, i], axis=0)) for i in range(CONTEXT)]) / len(w)
        before, back = _summed_by(contexts.T.ravel(), np.concatenate([dq * self.c[i] for i in range(CONTEXT)]))
        self._moved("S", gS)
        self._moved("t", gt)
        self._moved("R", moves[:, :DIM], symbols)
        self._moved("b", moves[:, DIM], symbols)
        self._moved("c", gc)
        self._moved("E", back, before)


def contexts_of(texts: list[np.ndarray], end: int) -> np.ndarray:
    """The CONTEXT symbols before each symbol of texts, nearest first; ends stand before the start of a text."""
    flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(flat), CONTEXT), end, np.int64)
    for i in range(CONTEXT):
        inside = np.flatnonzero(at > i)
        out[inside, i] = flat[inside - i - 1]
    return out


# --- passes over the corpus ----------------------------------------------------------------------------------

_BLOCKS = "block bigint, word string, place int, n bigint, class int, doc_id {id}, held boolean, tokens binary"
_RESOLVED = "doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, inner double, symbols binary"


def _arrow(ddl: str, id_type: pa.DataType) -> pa.Schema:
    from lacuna.llm.workspace import arrow_schema

    names = [x.split()[0] for x in ddl.split(", ")]
    plain = arrow_schema(ddl.format(id="bigint"))
    return pa.schema([pa.field(n, id_type if n == "doc_id" else plain.field(n).type) for n in names])


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def dictionaries(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of words (block, word, place, n in training, class) and of documents (block, doc_id, held, tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        block, schema = TaskContext.get().partitionId() << 24, None
        places, counts, total = defaultdict(count().__next__), np.zeros(0, np.int64), 0

        def words():
            names = list(places)
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                strings = [w.decode() for w in part]
                yield _batch(schema, len(part), block=[block] * len(part), word=strings, place=np.arange(k, k + len(part), dtype=np.int32), n=counts[k : k + len(part)], **{"class": [class_of(w) for w in strings]})

        for batch in batches:
            schema = schema or _arrow(_BLOCKS, batch.schema.field("doc_id").type)
            for k, n in portions(batch.column(2), 500):
                part = batch.slice(k, n)
                rows = [np.array([*map(places.__getitem__, (t or "").encode().lower().split()), places[END.encode()]], np.int32) for t in part.column(2).to_pylist()]
                train = [r for r, held in zip(rows, part.column(1).to_pylist(), strict=True) if not held]
                own = np.bincount(np.concatenate(train) if train else np.empty(0, np.int64), minlength=len(places))
                own[: len(counts)] += counts
                counts = own
                total += sum(map(len, rows))
                yield _batch(schema, len(rows), block=[block] * len(rows), doc_id=part.column(0), held=part.column(1), tokens=[squeezed(r) for r in rows])
                if total >= BLOCK_TOKENS:
                    yield from words()
                    block, places, counts, total = block + 1, defaultdict(count().__next__), np.zeros(0, np.int64), 0
        if places:
            yield from words()

    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, _BLOCKS.format(id=kind).replace("class int", "`class` int"))


def _resolve(blocks: DataFrame, counts: DataFrame, vocabulary: DataFrame, total: int, distinct: int, inside: dict[int, tuple[int, int]]) -> DataFrame:
    kind = blocks.schema["doc_id"].dataType.simpleString()
    known = counts.join(F.broadcast(vocabulary), "word", "left").select("word", "c", "symbol")  # VOCABULARY rows
    words = blocks.filter("word is not null").select("block", "word", "place", "class").join(known, "word").select("block", F.lit(0).alias("kind"), "place", "c", F.coalesce("symbol", F.lit(-1)).alias("symbol"), "class")
    rows = blocks.filter("tokens is not null").select("block", F.lit(1).alias("kind"), "doc_id", "held", "tokens")
    n_blocks = blocks.filter("place = 0").count()
    stream = words.unionByName(rows, allowMissingColumns=True).repartition(max(1, min(2 * n_blocks, 100_000)), "block").sortWithinPartitions("block", "kind", "place")
    first_class = 1 + VOCABULARY
    unseen, seen_part = (np.array(x) for x in zip(*(shares(*inside.get(k, (0, 0))) for k in range(CLASSES)), strict=True))

    def run(batches):
        names = ["block", "kind", "place", "c", "symbol", "class"]
        schema, block, table, parts = None, None, None, []
        for batch in batches:
            schema = schema or _arrow(_RESOLVED, batch.schema.field("doc_id").type)
            key = np.stack([batch.column(n).to_numpy() for n in names[:2]], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a, 0] != block:
                    block, table, parts = key[a, 0], None, []
                if key[a, 1] == 0:
                    parts.append([batch.column(n).slice(a, b - a).to_numpy() for n in names[3:]])
                    continue
                if table is None:
                    c, symbol, group = (np.concatenate(x) for x in zip(*parts, strict=True))
                    rare = symbol < 0
                    table = np.log10((c + 1) / (total + distinct + 1)), c > 0, np.where(rare, first_class + group, symbol).astype(np.uint16), np.where(rare, np.where(c > 0, np.log10(np.maximum(c, 1)) + seen_part[group], unseen[group]), 0.0)
                    parts = []
                base, seen, symbols, inner = table
                for k in range(a, b, 500):
                    part = batch.slice(k, min(500, b - k))
                    tokens = [expanded(t, np.int32) for t in part.column("tokens").to_pylist()]
                    yield _batch(schema, len(tokens), doc_id=part.column("doc_id"), held_out=part.column("held"), n_tokens=[len(t) for t in tokens], n_known=[int(seen[t].sum()) for t in tokens], base_score=[float(base[t].sum()) for t in tokens], inner=[float(inner[t].sum()) for t in tokens], symbols=[squeezed(symbols[t]) for t in tokens])

    return stream.mapInArrow(run, _RESOLVED.format(id=kind))


def _texts(column: pa.Array, slot: np.ndarray):
    """Lists of the slots of neighbouring texts, some BATCH tokens at a time at least."""
    texts, size = [], 0
    for t in column:
        texts.append(slot[expanded(t.as_py(), np.uint16)])
        size += len(texts[-1])
        if size >= 8 * BATCH:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _company(resolved: DataFrame) -> np.ndarray:
    """How often each symbol follows each of the COMPANY first ones in training rows: (COMPANY, symbols)."""

    def run(batches):
        total = np.zeros((COMPANY, N_SYMBOLS), np.int64)
        for batch in batches:
            for texts in _texts(batch.column(0), np.arange(N_SYMBOLS)):
                before, after = contexts_of(texts, 0)[:, 0], np.concatenate(texts)
                known = before < COMPANY
                total += np.bincount(before[known] * N_SYMBOLS + after[known], minlength=total.size).reshape(total.shape)
        yield _summands(total, 0, 1)

    return _added_up(resolved.filter("not held_out").select("symbols").mapInArrow(run, _SUMMANDS), COMPANY * N_SYMBOLS, np.int64)[0].reshape(COMPANY, N_SYMBOLS)


_SUMMANDS = "k int, shard bigint, n bigint, part binary"
_CHUNK = 1 << 16


def _summands(values: np.ndarray, shard: int, n: int) -> pa.RecordBatch:
    """A vector in chunks, of weight n."""
    flat = values.ravel()
    packed = squeezed if flat.dtype == np.int64 else rounded
    parts = [packed(flat[k : k + _CHUNK]) for k in range(0, len(flat), _CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["k", "shard", "n", "part"])


def _added_up(parts: DataFrame, size: int, kind) -> tuple[np.ndarray, int]:
    """The weighted sum of vectors of int64 or float32, and of their weights: chunk by chunk, in order of shards, so that it is always the same."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, part in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "part")), strict=True):
                own = sums.setdefault(k, [0, 0.0])
                own[0] += n
                own[1] = own[1] + n * (expanded(part, kind) if kind is np.int64 else widened(part)).astype(np.float64)
        for k, (n, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int64()), pa.array([n], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["k", "shard", "n", "part"])

    rows = parts.repartition(-(-size // _CHUNK), "k").sortWithinPartitions("k", "shard").mapInArrow(run, _SUMMANDS).collect()  # one vector
    out = np.zeros(size)
    for r in rows:
        v = np.frombuffer(r["part"], np.float64)
        out[r["k"] * _CHUNK : r["k"] * _CHUNK + len(v)] = v
    return out, max((r["n"] for r in rows), default=0)


def _train(resolved: DataFrame, counts: np.ndarray, slot: np.ndarray, total: int, folder: str) -> np.ndarray:
    """State of the model after one pass, in TURNS."""
    sc, shards = resolved.sparkSession.sparkContext, max(1, -(-total // SHARD_TOKENS))
    rows = resolved.filter("not held_out").select(F.xxhash64("doc_id", "symbols").alias("h"), "symbols").withColumn("shard", F.pmod("h", F.lit(shards))).withColumn("turn", F.expr(f"pmod(h div {shards}, {max(1, TURNS)})"))
    # sorted by turn, so that a turn reads its own pages of a file alone
    dealt = to_table(rows.repartition(shards, "shard").sortWithinPartitions("turn", "shard", "h", "symbols"), f"{folder}/shards")
    state = LogBilinear(counts).state
    for turn in range(TURNS):
        sent = sc.broadcast(state)

        def run(batches, sent=sent, turn=turn):
            at, held, model, rng, left = None, 0, None, None, []

            def learn():
                nonlocal left, held
                if left:
                    contexts, w = contexts_of(left, slot[0]), np.concatenate(left)
                    for k in range(0, len(w), BATCH):
                        model.step(contexts[k : k + BATCH], w[k : k + BATCH], rng)
                    left, held = [], 0

            for batch in batches:
                shard = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if shard[a] != at:
                        if model is not None:
                            learn()
                            yield _summands(model.moves(sent.value), at, 1)
                        at, model, rng = int(shard[a]), LogBilinear(counts, sent.value), np.random.default_rng([SEED, turn, int(shard[a])])
                    for k in range(a, b):
                        left.append(slot[expanded(batch.column("symbols")[k].as_py(), np.uint16)])
                        held += len(left[-1])
                        if held >= 8 * BATCH:
                            learn()
            if model is not None:
                learn()
                yield _summands(model.moves(sent.value), at, 1)

        added, n = _added_up(dealt.filter(F.col("turn") == turn).select("shard", "symbols").mapInArrow(run, _SUMMANDS), len(state), np.float32)
        sent.destroy()
        if n:
            state = LogBilinear.joined(state, added, n)
    return state


def score(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` for every row; tables go below folder."""
    blocks = to_table(dictionaries(docs, text, id_col), f"{folder}/blocks")
    counts = to_table(blocks.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"), F.max("class").alias("class")), f"{folder}/counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = counts.filter((F.col("c") > 0) & (F.col("word") != END)).orderBy(F.desc("c"), "word").limit(VOCABULARY).select("word", "c").collect()
    ends = counts.filter(F.col("word") == END).select("c").collect()
    names = {END: 0} | {r["word"]: k + 1 for k, r in enumerate(top)}
    vocabulary = docs.sparkSession.createDataFrame(list(names.items()), "word string, symbol int")
    rare = counts.join(F.broadcast(vocabulary), "word", "left_anti").filter("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()  # CLASSES rows
    inside = {r["class"]: (r["n"], r["once"]) for r in rare}
    frequency = np.zeros(N_SYMBOLS)
    frequency[0] = ends[0]["c"] if ends else 0
    frequency[1 : len(top) + 1] = [r["c"] for r in top]
    for k, (n, _) in inside.items():
        frequency[1 + VOCABULARY + k] = n
    resolved = to_table(_resolve(blocks, counts, vocabulary, total, distinct, inside), f"{folder}/resolved")
    slot = grouped(_company(resolved))
    by_slot = np.full(SLOTS, -1.0)
    by_slot[slot] = frequency
    state = docs.sparkSession.sparkContext.broadcast(_train(resolved, by_slot, slot, total, folder))

    def run(batches):
        model = LogBilinear(by_slot, state.value)
        for batch in batches:
            out = [np.empty(0)]
            for texts in _texts(batch.column("symbols"), slot):
                each = model.log_probabilities(contexts_of(texts, slot[0]), np.concatenate(texts))
                sizes = np.array([len(t) for t in texts])
                out.append(np.add.reduceat(each, np.cumsum(sizes) - sizes) / np.log(10))
            scores = np.concatenate(out) + batch.column("inner").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(scores)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = resolved.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_log_bilinear_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "lm"))
