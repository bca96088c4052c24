"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

A text is its lower-cased words; each word's subword ids start with the space
before it, and an end id closes the text.  The model predicts the class of the
next id from a window of the ids before it; frequent ids are classes of their
own and the rest share a class with ids of like frequency, and within a class
an id has its share of all training ids.  A class is predicted in two steps, its
group and its place there, so that two short softmaxes stand for one long one.
The logits start from the smoothed log counts of class after class; attention
over the window learns what those leave open.  Windows overlap by half: a chunk of
``CHUNK`` ids attends to itself and to the chunk before, so each id is scored
once, by attention batched over all chunks of a block under one mask.

All training documents take part, whole: ids, and pairs of classes, are counted over every
one of their tokens, and gradients are taken on every chunk of every training document.  Each
round takes its share of the chunks, dealt by a hash of their place, so that all rounds
together take each chunk once.  In a round every task learns from the blocks it reads, a shard
of ``SHARD_WINDOWS`` chunks at a time; every shard trains from the same start, the models are
averaged, and the next round starts from the average.

The base score is that of add-one word counts.  Word counts of all training
documents are summed by the block exchange: a word occurs once a block there.

Defined results: null or empty text is the end alone; a null ``doc_id`` is trained
on; repeated rows each count and get a row; without training documents all
counts are 0 and the model is its start; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import blocks as B
from corpusmill.llm.common import batches, id_and_bytes, raw_values, stage, table
from corpusmill.llm.tokens import encoder

FOLDS, HELD_OUT = 7, 2
END_ID = 50257  # beyond the vocabulary
GROUPS, PLACES, DIM, HIDDEN, CHUNK = 32, 32, 16, 32, 16
CLASSES = GROUPS * PLACES
SHARED = 16  # classes that several ids share
PIECE, ROUNDS = 1024, 2
SHARD_WINDOWS, BATCH, RATE = 100_000, 128, 0.03
SCORED = 128  # chunks of one batch of attention, whose arrays so stay in a core's cache
SMOOTHING = 30.0  # tokens that the shares of all classes weigh in the counts after one class
BLOCK_BYTES = 1 << 19  # of 16-bit ids
_NONE = 0xFFFF


def is_held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from learning; a missing id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def word_ids(raws: list[bytes | None], path: str | None = None) -> list[bytes]:
    """Subword ids (16 bits) of the lower-cased words of texts, each word encoded with a space before it."""
    own = encoder(path)
    words = [(r or b"").lower().split() for r in raws]
    joined = [b" ".join([b"", *w]) for w in words]
    # white space outside ASCII is part of a word here but not there: such texts go word by word
    plain = [j.isascii() or len(j.decode("utf-8", "replace").split()) == len(w) for w, j in zip(words, joined)]
    ids, bounds = own.encode(pa.array([j if p else b"" for j, p in zip(joined, plain)], pa.binary()))
    out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for k, w in enumerate(words):
        if not plain[k]:
            out[k] = b"".join(own.whole(" " + x.decode("utf-8", "replace")).tobytes() for x in w)
    return out


def to_id_blocks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Blocks whose texts are subword ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(parts):
        for b in parts:
            yield batches({"doc_id": b.column(0), "raw": word_ids(list(raw_values(b.column(1))), path)}, schema)

    return B.to_blocks(id_and_bytes(docs).mapInArrow(run, "doc_id long, raw binary"), BLOCK_BYTES, "tokens")


class Ids:
    """The documents of a block as one id array with word hashes."""

    _SCRAMBLE = None

    def __init__(self, row: dict, opens: np.ndarray):
        block = B.open_block(row)
        self.doc_ids = [int(i) if k else None for i, k in zip(block.ids, block.known)]
        self.held = np.array([is_held_out(i) for i in self.doc_ids], bool)
        self.lengths = np.array([len(t or b"") // 2 for t in block.texts], np.int64)
        self.ids = np.frombuffer(b"".join(t for t in block.texts if t), np.uint16)
        self.starts = np.flatnonzero(opens[self.ids])
        self.of_doc = np.repeat(np.arange(len(self.lengths)), self.lengths)[self.starts] if len(self.ids) else self.starts

    def words(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        if Ids._SCRAMBLE is None:
            Ids._SCRAMBLE = B.mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
        size = np.diff(self.starts, append=len(self.ids))
        place = np.arange(len(self.ids)) - np.repeat(self.starts, size)
        power = B._power(B.STEPS[0], int(size.max()) + 1, False)
        return B.mixed(np.add.reduceat(Ids._SCRAMBLE[self.ids] * power[place], self.starts) + size.astype(np.uint64))


def _opens(path: str | None) -> np.ndarray:
    """Which ids start a word; the words a reused worker remembers from encoding are let go."""
    own = encoder(path)
    own.forget()
    return own.opens


def _word_keys(path: str | None):
    def keys(row: dict) -> tuple[np.ndarray, bytes]:
        """The block's distinct words, each with its training count."""
        own = Ids(row, _opens(path))
        key, inverse = np.unique(own.words(), return_inverse=True)
        count = np.bincount(inverse, weights=~own.held[own.of_doc], minlength=len(key)) if len(key) else np.zeros(0)
        return key, count.astype("<u4").tobytes()

    return keys


def _sum_counts(keys: np.ndarray, owner: np.ndarray, payload: bytes) -> np.ndarray:
    _, inverse = np.unique(keys, return_inverse=True)
    return np.bincount(inverse, weights=np.frombuffer(payload, "<u4")).astype(np.int64)[inverse]


def _distinct(keys: np.ndarray, found: np.ndarray) -> bytes:
    return np.array([len(np.unique(keys[found > 0]))], np.int64).tobytes()


# The model.


SHAPES = {
    "E": (CLASSES, DIM), "PQ": (CHUNK, DIM), "PK": (2 * CHUNK, DIM), "Wq": (DIM, DIM), "Wk": (DIM, DIM), "Wv": (DIM, DIM),
    "W1": (DIM, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, DIM), "Ug": (DIM, GROUPS), "bg": (GROUPS,), "Up": (GROUPS, DIM, PLACES), "bp": (GROUPS, PLACES),
}


def start(seed: int = 7) -> dict[str, np.ndarray]:
    """The parameters that every training starts from; nothing is added to the counts yet."""
    r = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k[0] in "bU" else r.normal(0, 0.5 if k == "E" else 0.25, s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def views(v: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters inside one array."""
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k] = v[at : at + size].reshape(shape)
        at += size
    return out


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    return views(v.astype(np.float32))


class Prior:
    """Smoothed log probabilities of a class after a class, as those of its group and of its place there."""

    def __init__(self, pairs: np.ndarray):
        """``pairs[a, b]``: how often class b follows class a."""
        alone = pairs.sum(0) + 0.5
        p = pairs + SMOOTHING * alone / alone.sum()
        p = (p / p.sum(1, keepdims=True)).reshape(CLASSES, GROUPS, PLACES)
        group = p.sum(2)
        self.group = np.log(group).astype(np.float32)
        self.place = np.log(p / group[:, :, None]).astype(np.float32)


_CAUSAL = np.where(np.arange(2 * CHUNK)[None, :] <= np.arange(CHUNK)[:, None] + CHUNK, 0.0, -1e9).astype(np.float32)


_ONES = np.ones((GROUPS + PLACES + 2 * CHUNK, 1), np.float32)
_PAIRED = {"f": np.complex64, "d": np.complex128}  # two neighbours as one number, whose sums are theirs


def _shares(logits: np.ndarray) -> np.ndarray:
    """Logits become their exponentials; returns the sums of rows, by a product with ones, as reductions of short rows cost more."""
    if logits.max() > 80:
        np.minimum(logits, 80, out=logits)
    np.exp(logits, out=logits)
    total = (logits.reshape(-1, logits.shape[-1]) @ _ONES[: logits.shape[-1]])[:, 0]
    total += np.float32(1e-30)
    return total


def _by_shares(e: np.ndarray, want: np.ndarray, heavy: np.ndarray) -> float:
    """Weighted loss of logits, which become its gradients; shares are never made: their sums and weights scale a row at once."""
    total, at = _shares(e), np.arange(len(want)) * e.shape[1] + want
    flat_e = e.reshape(-1)
    picked = flat_e.take(at)
    loss = -float((np.log(picked / total + 1e-30) * heavy).sum())
    flat_e[at] = picked - total
    heavy = heavy / total
    e *= heavy[:, None]
    return loss


def by_class(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The sum of each class's rows, two neighbouring columns at a time and without sorting."""
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    pair = _PAIRED[rows.dtype.char]
    np.add.at(out.view(pair).reshape(-1), _PLACE_OF_PAIR.take(classes, 0).reshape(-1), rows.view(pair).reshape(-1))
    return out


_PLACE_OF_PAIR = np.arange(CLASSES * DIM // 2).reshape(CLASSES, -1)


def _and_one(rows: int, kind: np.dtype) -> np.ndarray:
    """Rows of a vector and a one, whose weight is the bias."""
    out = np.empty((rows, DIM + 1), kind)
    out[:, DIM] = 1
    return out


def gradients(p: dict[str, np.ndarray], prior: Prior, inputs: np.ndarray, present: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the counted targets and its gradients: forward and backward through one attention layer.

    Keys, values and queries are made once a class, and an id takes its class's.  From attention on, rows
    stand in order of their target's group, so that a group's rows are a slice.  Exponentials stay as they
    are, and the sums of their rows scale the shorter rows that they are multiplied with.
    """
    kind, n = p["E"].dtype, len(inputs)
    scale = np.asarray(DIM**-0.5, kind)
    d: dict[str, np.ndarray] = {}
    seen, now, then = inputs.ravel(), inputs[:, CHUNK:].ravel(), targets.ravel()
    x, xq = p["E"].take(seen, 0), p["E"].take(now, 0)
    both = np.concatenate([p["Wk"], p["Wv"]], 1)
    kv = (p["E"] @ both).take(seen, 0).reshape(n, 2 * CHUNK, 2 * DIM)
    kv += np.concatenate([p["PK"], np.zeros_like(p["PK"])], 1)
    k, v = kv[:, :, :DIM], kv[:, :, DIM:]
    wq = p["Wq"] * scale
    q = (p["E"] @ wq).take(now, 0).reshape(n, CHUNK, DIM)
    q += p["PQ"] * scale
    a = q @ k.swapaxes(1, 2)
    a += _CAUSAL
    row, spot = np.divmod(np.flatnonzero(~present), 2 * CHUNK)
    a[row, :, spot] -= 1e9
    shrink = np.reciprocal(_shares(a))[:, None]
    met = (a @ v).reshape(-1, DIM)
    met *= shrink

    group = then // PLACES
    order = np.argsort(group.astype(np.int8), kind="stable")
    group, place, ahead = group.take(order), (then % PLACES).take(order), now.take(order)
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    some = [(m, slice(cuts[m], cuts[m + 1])) for m in range(GROUPS) if cuts[m] < cuts[m + 1]]
    heavy = counted.ravel().take(order).astype(kind)
    heavy /= max(1, np.count_nonzero(heavy))
    h = _and_one(len(now), kind)
    np.add(met, xq, out=h[:, :DIM])
    h = h.take(order, 0)
    r = h @ np.vstack([p["W1"], p["b1"]])
    wide = r.reshape(n, -1)  # loops over short rows and numbers cost more
    np.maximum(wide, np.zeros(wide.shape[1], kind), out=wide)
    g = _and_one(len(now), kind)
    np.add(r @ p["W2"], h[:, :DIM], out=g[:, :DIM])

    e = g @ np.vstack([p["Ug"], p["bg"]])
    e += prior.group.take(ahead, 0)
    loss = _by_shares(e, group, heavy)
    by = e.T @ g
    d["Ug"], d["bg"], dg = by[:, :DIM].T, by[:, DIM], e @ p["Ug"].T

    up, parts = np.concatenate([p["Up"], p["bp"][:, None]], 1), [(m, g[rows], e[rows]) for m, rows in some]
    for m, given, made in parts:
        np.dot(given, up[m], made)
    e += prior.place.reshape(-1, PLACES).take(ahead * GROUPS + group, 0)
    loss += _by_shares(e, place, heavy)
    by, back = np.zeros((GROUPS, PLACES, DIM + 1), kind), np.empty_like(dg)
    for (m, given, made), (_, rows) in zip(parts, some):
        np.dot(made.T, given, by[m])
        np.dot(made, p["Up"][m].T, back[rows])
    d["Up"], d["bp"] = by[:, :, :DIM].swapaxes(1, 2), by[:, :, DIM]
    dg += back

    d["W2"] = r.T @ dg
    dz = dg @ p["W2"].T
    dz *= r > 0
    by = dz.T @ h
    d["W1"], d["b1"] = by[:, :DIM].T, by[:, DIM]
    dg += dz @ p["W1"].T
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh = dg.take(back, 0)

    met *= dh
    part = (dh * shrink).reshape(n, CHUNK, DIM)
    ds = part @ v.swapaxes(1, 2)
    ds -= (met @ np.ones((DIM, 1), kind) * shrink).reshape(n, CHUNK, 1)  # the sum of a * da
    ds *= a
    dkv = np.empty_like(kv)
    np.matmul(ds.swapaxes(1, 2), q, out=dkv[:, :, :DIM])
    np.matmul(a.swapaxes(1, 2), part, out=dkv[:, :, DIM:])
    dq = (ds @ k).reshape(-1, DIM)
    d["Wq"], d["PQ"] = xq.T @ dq * scale, dq.reshape(n, -1).sum(0).reshape(CHUNK, DIM) * scale
    d["PK"] = dkv.reshape(n, -1).sum(0).reshape(2 * CHUNK, 2 * DIM)[:, :DIM]
    dkv = dkv.reshape(-1, 2 * DIM)
    by = dkv.T @ x
    d["Wk"], d["Wv"] = by[:DIM].T, by[DIM:].T
    dx = dkv @ both.T
    dh += dq @ wq.T
    dx.reshape(n, 2, CHUNK * DIM)[:, 1] += dh.reshape(n, -1)
    d["E"] = by_class(dx, seen)
    return loss, d


def train_shard(p: dict[str, np.ndarray], prior: Prior, windows: np.ndarray, classes: np.ndarray, round_: int) -> dict[str, np.ndarray]:
    """One pass of Adam over one shard's windows (rows of 2 * CHUNK inputs and CHUNK targets, as ids or none)."""
    own = flat(p)
    p, m, v, step = views(own), np.zeros_like(own), np.zeros_like(own), 0
    of = np.full(_NONE + 1, classes[0])
    of[: len(classes)] = classes
    dealt = np.array_split(np.random.default_rng(round_).permutation(len(windows)), max(1, len(windows) // BATCH))
    for at in dealt:
        rows = windows.take(at, 0)
        known, c = rows != _NONE, of.take(rows)
        _, g = gradients(p, prior, c[:, : 2 * CHUNK], known[:, : 2 * CHUNK], c[:, 2 * CHUNK :], known[:, 2 * CHUNK :])
        step += 1
        rate = RATE * (1 - 0.9 * (step / len(dealt))) / (1 + round_)
        by = flat(g)
        m *= 0.9  # m and v are ten and a hundred times the means of Adam
        m += by
        by *= by
        v *= 0.99
        v += by
        np.sqrt(v, out=by)
        part = (0.01 / (1 - 0.99**step)) ** 0.5
        by += 1e-8 / part
        np.divide(m, by, out=by)
        by *= 0.1 * rate / (1 - 0.9**step) / part
        own -= by
    return p


class Chunks:
    """The chunks of texts that lie one after another: what each reads and is to predict, ``none`` where a text has ended."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, end: int, none: int, dtype: type):
        count = lengths // CHUNK + 1  # of the ids and the end
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.total = int(self.first[-1])
        self.inputs, self.targets = np.full((self.total, CHUNK), none, dtype), np.full((self.total, CHUNK), none, dtype)
        self.begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.repeat(self.first[:-1] * CHUNK - self.begin, lengths) + np.arange(len(symbols))
        self.targets.ravel()[place] = symbols
        self.targets.ravel()[self.first[:-1] * CHUNK + lengths] = end
        self.inputs.ravel()[place + 1] = symbols
        self.inputs.ravel()[self.first[:-1] * CHUNK] = end
        self.fresh, self.none = np.zeros(self.total, bool), none
        self.fresh[self.first[:-1]] = True

    def seen(self, at: np.ndarray) -> np.ndarray:
        """The chunk before and the chunk itself."""
        out = np.concatenate([self.inputs[np.maximum(at - 1, 0)], self.inputs[at]], 1)
        out[:, :CHUNK][self.fresh[at]] = self.none
        return out


def _texts_of(row: dict, training: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of a block's texts, or of those that are learnt from."""
    block = B.open_block(row)
    texts = [t or b"" for i, known, t in zip(block.ids.tolist(), block.known.tolist(), block.texts) if not training or not is_held_out(i if known else None)]
    return np.frombuffer(b"".join(texts), np.uint16), np.array([len(t) // 2 for t in texts], np.int64)


def windows_of(row: dict, turns: int = 1, turn: int = 0) -> np.ndarray:
    """Training rows of the chunks of a block's training documents, each of which has one of ``turns`` turns."""
    ids, lengths = _texts_of(row, True)
    chunks = Chunks(ids, lengths, END_ID, _NONE, np.uint16)
    key = B.mixed((np.uint64(row["block"]) << np.uint64(24)) + np.arange(chunks.total, dtype=np.uint64))
    at = np.flatnonzero(key % np.uint64(turns) == turn)
    return np.concatenate([chunks.seen(at), chunks.targets[at]], 1)


def training_windows(blocks: DataFrame, turns: int = 1) -> DataFrame:
    """(block, piece, n, windows) of all training documents, or of the first of ``turns`` turns; at most ``PIECE`` windows a row."""
    schema = pa.schema([("block", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("windows", pa.binary())])

    def run(parts):
        for b in parts:
            for row in B.rows_of(b):
                found = windows_of(row, turns)
                for k in range(0, len(found), PIECE):
                    part = found[k : k + PIECE]
                    yield batches({"block": [row["block"]], "piece": [k // PIECE], "n": [len(part)], "windows": [part.tobytes()]}, schema)

    return blocks.mapInArrow(run, "block long, piece long, n long, windows binary")


def class_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id, and log10 of its share of its class: from the ids' training counts."""
    order = np.argsort(-counts, kind="stable")
    classes = np.empty(len(counts), np.int64)
    own = CLASSES - SHARED
    classes[order[:own]] = np.arange(own)  # neighbours in frequency
    rest = counts[order[own:]] + 0.1
    classes[order[own:]] = own + np.minimum((np.cumsum(rest) - rest) / rest.sum() * SHARED, SHARED - 1).astype(int)
    classes = classes % GROUPS * PLACES + classes // GROUPS  # go to different groups, which so weigh alike
    weight = counts + 0.1
    return classes, np.log10(weight / np.bincount(classes, weights=weight, minlength=CLASSES)[classes])


class Scorer:
    """Scores the ids of whole blocks."""

    def __init__(self, p: dict[str, np.ndarray], prior: Prior, classes: np.ndarray, share: np.ndarray):
        self.classes, self.share = classes.astype(np.int16), share
        self.group, self.place = prior.group + p["bg"], (prior.place + p["bp"]).reshape(-1, PLACES)
        scale = np.float32(DIM**-0.5)
        self.e = p["E"]
        self.q, self.k, self.v = p["E"] @ p["Wq"] * scale, p["E"] @ p["Wk"], p["E"] @ p["Wv"]
        self.pq, self.pk, self.p = p["PQ"] * scale, p["PK"], p

    def log10(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text, end included; ``ids`` are the texts' ids one after another."""
        if not len(lengths):
            return np.zeros(0)
        chunks = Chunks(self.classes[ids], lengths, self.classes[END_ID], -1, np.int16)
        out = np.concatenate([self.chunks(chunks, at, min(at + SCORED, chunks.total)).sum(1, dtype=np.float64) for at in range(0, chunks.total, SCORED)])
        within = np.add.reduceat(out, chunks.first[:-1])
        sums = np.concatenate([[0.0], np.cumsum(self.share[ids])])
        return within / np.log(10) + sums[np.cumsum(lengths)] - sums[chunks.begin] + self.share[END_ID]

    def chunks(self, chunks: Chunks, at: int, to: int) -> np.ndarray:
        """Natural log probability of each wanted class of chunks at..to, by one batch of masked attention."""
        now, seen = chunks.inputs[at:to], chunks.seen(np.arange(at, to))
        q = self.q.take(now, 0, mode="wrap")  # -1, where a text has ended, is the last class
        q += self.pq
        k = self.k.take(seen, 0, mode="wrap")
        k += self.pk
        s = q @ k.swapaxes(1, 2)
        s += _CAUSAL
        row, spot = np.divmod(np.flatnonzero(seen < 0), 2 * CHUNK)
        s[row, :, spot] -= 1e9
        total = _shares(s)
        h = (s @ self.v.take(seen, 0, mode="wrap")).reshape(-1, DIM)
        h /= total[:, None]
        h += self.e.take(now.ravel(), 0, mode="wrap")
        want, ahead = chunks.targets[at:to].ravel().astype(np.int32), now.ravel().astype(np.int32)
        value = np.zeros(len(want), np.float32)
        group = want // PLACES  # -1 where a text has ended
        order = np.argsort(group.astype(np.int8), kind="stable")
        cuts = np.cumsum(np.bincount(group + 1, minlength=GROUPS + 1))
        order = order[cuts[0] :]
        cuts = (cuts - cuts[0]).tolist()
        want, ahead, group, h = want.take(order), ahead.take(order), group.take(order), h.take(order, 0)
        r = h @ self.p["W1"]
        r += self.p["b1"]
        np.maximum(r, 0, out=r)
        h += r @ self.p["W2"]
        logits = h @ self.p["Ug"]
        logits += self.group.take(ahead, 0)
        own = self._log_softmax(logits, group)
        for m in range(GROUPS):
            if cuts[m] < cuts[m + 1]:
                np.dot(h[cuts[m] : cuts[m + 1]], self.p["Up"][m], logits[cuts[m] : cuts[m + 1]])
        logits += self.place.take(ahead * GROUPS + group, 0)
        own += self._log_softmax(logits, want % PLACES)
        value[order] = own
        return value.reshape(-1, CHUNK)

    @staticmethod
    def _log_softmax(logits: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Natural log probability of the wanted column of each row; logits become their exponentials."""
        picked = logits.reshape(-1).take(np.arange(len(want)) * logits.shape[1] + want)
        return np.minimum(picked, 80) - np.log(_shares(logits))


def _trainer(p: dict[str, np.ndarray], prior: Prior, classes: np.ndarray, round_: int):
    def trained(windows: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(windows)
        v = flat(train_shard(p, prior, rows, classes, round_)).astype(float)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int64()), pa.array(v), pa.array(np.full(len(v), float(len(rows))))], names=["k", "v", "w"])

    def train(parts):
        held: list[np.ndarray] = []
        for b in parts:
            for row in B.rows_of(b):
                held.append(windows_of(row, ROUNDS, round_))
                if sum(map(len, held)) >= SHARD_WINDOWS:
                    yield trained(held)
                    held = []
        if sum(map(len, held)):
            yield trained(held)

    return train


def _counts(blocks: DataFrame, path: str | None) -> tuple[np.ndarray, int]:
    """How often each id occurs in all training documents, and their words and ends."""

    def count(parts):
        opens, total = _opens(path), np.zeros(1 << 16, np.int64)
        for b in parts:
            for row in B.rows_of(b):
                ids, lengths = _texts_of(row, True)
                total += np.bincount(ids, minlength=1 << 16)
                total[END_ID] += len(lengths)
        some = np.flatnonzero(total)
        words = int(total[opens].sum()) + int(total[END_ID])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([words, *total[some]], pa.int64())], names=["id", "n"])

    found = blocks.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(END_ID + 1, np.int64)
    for r in found:
        if r.id >= 0:
            counts[r.id] = r.n
    return counts, next((r.n for r in found if r.id < 0), 0)


def _pairs(blocks: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each class in all training documents."""
    end = int(classes[END_ID])
    schema = pa.schema([("a", pa.int32()), ("row", pa.binary())])

    def count(parts):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in parts:
            for row in B.rows_of(b):
                ids, lengths = _texts_of(row, True)
                stops = np.cumsum(lengths)
                now = np.insert(classes[ids], stops, end)  # an end before each text but the first
                total += np.bincount(np.concatenate([[end], now[:-1]]) * CLASSES + now, minlength=CLASSES * CLASSES) if len(lengths) else 0
        table = total.reshape(CLASSES, CLASSES)
        some = np.flatnonzero(table.any(1))
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            yield batches({"a": part.tolist(), "row": [table[k].tobytes() for k in part.tolist()]}, schema)

    def add(group: pa.Table) -> pa.Table:
        rows = group["row"].to_pylist()
        total = np.zeros(CLASSES, np.int64)
        for x in rows:
            total += np.frombuffer(x, np.int64)
        return pa.table({"a": group["a"].slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((CLASSES, CLASSES), np.int64)
    for r in blocks.mapInArrow(count, "a int, row binary").groupBy("a").applyInArrow(add, "a int, row binary").collect():  # a row a class
        out[r.a] = np.frombuffer(bytes(r.row), np.int64)
    return out


def learn(blocks: DataFrame, counts: np.ndarray) -> tuple[dict[str, np.ndarray], Prior]:
    """The trained parameters, and the counts that they add to."""
    classes, _ = class_table(counts)
    prior, p = Prior(_pairs(blocks, classes)), start()
    for round_ in range(ROUNDS):
        shards = blocks.mapInArrow(_trainer(p, prior, classes, round_), "k long, v double, w double")
        means = shards.groupBy("k").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
        found = sorted((r.k, r.v) for r in means.collect())  # one value a parameter
        if found:  # a round may have no chunk
            p = shaped(np.array([v for _, v in found], np.float32))
    return p, prior


def lm_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    spark = docs.sparkSession
    blocks = stage(to_id_blocks(docs, path), "lm-blocks")
    size = blocks.agg(F.sum(F.length("body")), F.count("*")).first()
    asked = B.ask(blocks, _word_keys(path), B.bucket_count(int(size[0] or 0) // 12), 4)
    answers = stage(B.answer(asked, _sum_counts, 8, _distinct), "lm-counts")
    counts, n_train = _counts(blocks, path)
    p, prior = learn(blocks, counts)
    classes, share = class_table(counts)
    found = answers.filter("block = -1").select("answers").collect()  # eight bytes a bucket
    ends = int(counts[END_ID])
    v_train = sum(int(np.frombuffer(bytes(r.answers), np.int64).sum()) for r in found) + (ends > 0)
    shared = spark.sparkContext.broadcast((p, prior, classes, share, n_train, v_train, ends))  # of the vocabulary's size
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def run(parts):
        p, prior, classes, share, n_train, v_train, ends = shared.value
        scorer, floor, opens = Scorer(p, prior, classes, share), np.log10(n_train + v_train + 1.0), _opens(path)
        for b in parts:
            for row in B.rows_of(b):
                own = Ids(row, opens)
                key, inverse = np.unique(own.words(), return_inverse=True)
                count = np.frombuffer(row["answers"] or b"", np.int64)[inverse] if len(key) else np.zeros(0, np.int64)
                n = len(own.doc_ids)
                words = np.bincount(own.of_doc, minlength=n)
                known = np.bincount(own.of_doc, weights=count > 0, minlength=n).astype(np.int64) + (ends > 0)
                base = np.bincount(own.of_doc, weights=np.log10(count + 1.0), minlength=n) + np.log10(ends + 1.0) - (words + 1) * floor
                yield batches(
                    {
                        "doc_id": own.doc_ids, "held_out": own.held.tolist(), "n_tokens": (words + 1).tolist(), "n_known": known.tolist(),
                        "train_tokens": [n_train] * n, "base_score": base.tolist(), "score": scorer.log10(own.ids, own.lengths).tolist(),
                    },
                    schema,
                )

    return blocks.join(answers.filter("block >= 0").hint("shuffle_merge"), "block", "left").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return lm_scores(table(spark, sf_dir, "documents"))
