"""Toxicity by a subsequence string-kernel machine with Nystrom landmarks.

The kernel compares two words by the letter subsequences of length three and
four they share, gaps allowed; a subsequence that spans m letters weighs
``DECAY ** m`` and words are scaled to unit length, so an insult with
letters put in or left apart still resembles itself.  Landmarks are words of
labelled sentences; a word's kernel values with them, whitened, are its Nystrom
features, and a linear support vector machine is trained on those.  Because the
kernel is an inner product of subsequence counts, the trained machine is one
table of subsequence weights, which makes scoring a pass over letters.

A document is labelled as a whole, so training is multiple-instance: of a toxic
document's sentences the most suspicious word is its witness, of a clean
document every word is clean.  The score is a logistic curve of the largest
word value, fitted to the labelled documents.  Only the fit uses a bounded sample:
at most ``TOXIC`` toxic and ``CLEAN`` clean labelled documents, by the hash of
their id; scoring reads every word of every text.

Defined results: null or empty text has the score of a text without
suspicious words; null labels are not learnt from; repeated rows each get a row;
without labelled rows of both kinds every score is 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import begin, give_back, id_and_bytes, raw_values, table
from corpusmill.llm.tokens import decode_text

#: Bounds of the labelled sample that the classifier is fitted on.
TOXIC, CLEAN = 1500, 2500
FOLDS, HELD_OUT = 5, 0
LETTERS, SPAN, DECAY = 32, 7, 0.6
LANDMARKS = 256
REMEMBERED = 150_000
PART = 4_000  # words whose values are computed at once, whose arrays so stay in a core's cache

#: Letters a-z keep their place; other letters fold into the last codes.
_BETWEEN = bytes(32 if b in b'.!?,;:"()[]{}<>/\\|' else b for b in range(256))  # with white space what stands between words
_CODES = {chr(97 + k): k + 1 for k in range(26)}
_STOP, _UNKNOWN = 254, 255
_BY_POINT = np.full(0x110000, _UNKNOWN, np.uint8)  # codes of characters, as far as they were met
_OFFSETS = {n: [(0, *c) for c in combinations(range(1, SPAN), n - 1)] for n in (3, 4)}


def code(word: str) -> list[int]:
    """Letter codes of a word; marks, digits and other signs inside it are passed over."""
    return [c for c in (_CODES.get(ch) or (27 + ord(ch) % 5 if ch.isalpha() else 0) for ch in word.lower()) if c]


def candidates(text: str) -> list[str]:
    """The words of a text, and each stretch of single letters written apart as one word."""
    spaced = text.encode("utf-8", "surrogatepass").translate(_BETWEEN).decode("utf-8", "surrogatepass")
    words = spaced.split()
    if not words:
        return ["", ""] if text else [""]
    if spaced[0].isspace():
        words.insert(0, "")
    if spaced[-1].isspace():
        words.append("")
    if 1 not in map(len, words):
        return words
    out, run = [], []
    for w in words:
        if len(w) == 1 and w.isalpha():
            run.append(w)
        elif run:
            if len(run) > 3:
                out.append("".join(run))
            run = []
    if len(run) > 3:
        out.append("".join(run))
    return out + words if out else words


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all words (without white space) with gaps that no subsequence bridges, word starts, and word lengths."""
    points = np.frombuffer("\n".join(words).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _BY_POINT[points]
    new = codes == _UNKNOWN
    if new.any():
        for p in np.unique(points[new]).tolist():
            _BY_POINT[p] = _STOP if p == 10 else sum(code(chr(p)))
        codes = _BY_POINT[points]
    codes = codes[codes > 0]
    stops = codes == _STOP
    lengths = np.diff(np.flatnonzero(stops), prepend=-1, append=len(codes)) - 1 if words else np.zeros(0, np.int64)
    starts = np.cumsum(lengths + SPAN) - lengths - SPAN
    flat = np.zeros(int((lengths + SPAN).sum()) + SPAN, np.int32)
    flat[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)) * SPAN, lengths)] = codes[~stops]
    return flat, starts, lengths


def _norms(lengths: np.ndarray) -> np.ndarray:
    """Length of a word's subsequence vector when no subsequence repeats."""
    longest = int(lengths.max()) if len(lengths) else 0
    square = np.zeros(longest + 1)
    n = np.arange(longest + 1)
    for offsets in _OFFSETS.values():
        for o in offsets:
            square += np.maximum(n - o[-1], 0) * DECAY ** (2 * (o[-1] + 1))
    return np.sqrt(square)[lengths]


def _keys(flat: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Number of the subsequence that starts at each letter, 0 where it leaves the word."""
    n = len(flat) - SPAN
    parts = [flat[o : o + n] for o in offsets]
    key = parts[0].copy()
    whole = parts[0] > 0
    for p in parts[1:]:
        key = key * LETTERS + p
        whole &= p > 0
    return np.where(whole, key, 0)


def features(words: list[str]) -> list[dict[int, float]]:
    """Scaled subsequence vectors of words, by subsequence number."""
    flat, starts, lengths = _laid_out(words)
    out: list[dict[int, float]] = [{} for _ in words]
    if not len(starts):
        return out
    owner = np.repeat(np.arange(len(words)), lengths + SPAN)
    for size, all_offsets in _OFFSETS.items():
        base = LETTERS**4 if size == 3 else 0
        for o in all_offsets:
            key = _keys(flat, o)
            for at in np.flatnonzero(key[: len(owner)]).tolist():
                own = out[owner[at]]
                k = int(key[at]) + base
                own[k] = own.get(k, 0.0) + DECAY ** (o[-1] + 1)
    norms = _norms(lengths)
    return [{k: v / n for k, v in f.items()} if n else f for f, n in zip(out, norms.tolist())]


def _kernel(rows: list[dict[int, float]], marks: list[dict[int, float]]) -> np.ndarray:
    """Kernel values of rows against landmarks, through an index of the landmarks' subsequences."""
    posting: dict[int, list[tuple[int, float]]] = {}
    for j, f in enumerate(marks):
        for k, v in f.items():
            posting.setdefault(k, []).append((j, v))
    out = np.zeros((len(rows), len(marks)))
    for i, f in enumerate(rows):
        for k, v in f.items():
            for j, w in posting.get(k, ()):
                out[i, j] += v * w
    return out


def _train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin."""
    a = np.hstack([x, np.ones((len(x), 1))])
    reg = np.full(a.shape[1], ridge)
    reg[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        inside = (1 - y * (a @ w)) > 0
        b = a[inside] * weight[inside, None]
        new = np.linalg.solve(b.T @ a[inside] + np.diag(reg) * 1.0, b.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = (w + new) / 2 if _ > 15 else new
    return w[:-1], float(w[-1])


class Model:
    """Tables of subsequence weights, the bias, and the logistic curve."""

    def __init__(self, three: np.ndarray, four: np.ndarray, bias: float, slope: float, shift: float):
        one = np.arange(LETTERS) > 0  # no subsequence has a letter of code 0
        spelt = np.logical_and.outer(np.logical_and.outer(one, one), one)
        self.three, self.four = three * spelt.ravel(), four * np.logical_and.outer(spelt, one).ravel()
        self.longer = self.four.reshape(-1, LETTERS).any(1)  # which three letters start four that weigh
        self.bias, self.slope, self.shift = bias, slope, shift
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; the tables of a part of the words are held at a time."""
        parts = [self._values(words[at : at + PART]) for at in range(0, len(words), PART)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _values(self, words: list[str]) -> np.ndarray:
        flat, starts, lengths = _laid_out(words)
        count = np.maximum(lengths - 2, 0)  # letters that two more follow
        owner = np.repeat(np.arange(len(lengths)), count)
        at = starts[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        letter = [flat[at + o] for o in range(SPAN)]  # 0 beyond the word
        total = np.zeros(len(at))
        for i in range(1, SPAN - 1):
            two = letter[0] * LETTERS + letter[i]
            for j in range(i + 1, SPAN):
                key = two * LETTERS + letter[j]
                total += self.three.take(key) * DECAY ** (j + 1)
                some = np.flatnonzero(self.longer.take(key)) if j + 1 < SPAN else ()
                if len(some):
                    first = key[some] * LETTERS
                    total[some] += sum(self.four.take(first + letter[k][some]) * DECAY ** (k + 1) for k in range(j + 1, SPAN))
        sums = np.bincount(owner, total, len(lengths))
        norms = _norms(lengths)
        return np.where(norms > 0, sums / np.maximum(norms, 1e-12), 0.0) + self.bias

    def most(self, texts: list[str]) -> np.ndarray:
        """The largest word value of each text; the bias where there is no word."""
        split = [set(candidates(t)) for t in texts]
        fresh = list(set().union(*split).difference(self.known)) if split else []
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(set().union(*split))
        for at in range(0, len(fresh), PART):
            part = fresh[at : at + PART]
            self.known.update(zip(part, self.values(part).tolist()))
        get = self.known.__getitem__
        return np.array([max(map(get, w)) if w else self.bias for w in split])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.most(texts) + self.shift, -50, 50)))


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 5) -> Model | None:
    """Train on labelled texts; None if one kind is missing."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    one: dict[str, str] = {}  # a word of many texts is held once
    bags = [sorted({one.setdefault(w, w) for w in candidates(t.lower()) if len(code(w)) >= 3}) for t in texts]
    del one
    seen = [Counter(w for b, t in zip(bags, toxic) if t == kind for w in b) for kind in (False, True)]
    n = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]
    odds = {w: np.log(((c + 0.2) / n[1]) / ((seen[0][w] + 0.2) / n[0])) for w, c in seen[1].items()}
    # toxic documents alone hold a word this often by chance in less than a tenth of such samples
    chance = max(3.0, np.log(0.1 / max(1, len(odds))) / np.log(n[1] / (n[0] + n[1])))
    lasting = sorted((w for w in odds if seen[1][w] >= chance and odds[w] > 2), key=lambda w: (-seen[1][w], w))
    if not lasting:
        lasting = sorted(odds, key=lambda w: (-odds[w] * seen[1][w], w))[:8]
    positive = lasting[: 4 * landmarks]
    clean = sorted(seen[0], key=lambda w: (-seen[0][w], w))
    marks = positive[: landmarks // 2] + clean[: landmarks // 2]
    mark_rows = features(marks)
    gram = _kernel(mark_rows, mark_rows)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    kept = value > 1e-3 * value[-1]
    whiten = vector[:, kept] / np.sqrt(value[kept])
    negative = clean[: 12 * landmarks]
    model = None
    for _ in range(rounds):
        common = sorted(positive, key=lambda w: (-seen[1][w], w))[: landmarks // 2]
        positive = common + sorted(set(positive) - set(common))
        spread = [w[:k] + c + w[k:] for w in common for k, c in ((len(w) // 2, "x"), (len(w) // 3, "q"), (-2, w[-2]), (-1, "o"))]
        words = positive + spread + negative  # insults with a letter put in stay insults
        x = np.vstack([_kernel(features(words[i : i + 512]), mark_rows) for i in range(0, len(words), 512)]) @ whiten
        y = np.concatenate([np.ones(len(positive) + len(spread)), -np.ones(len(negative))])
        often = np.sqrt([1.0 + seen[1][w] for w in positive])  # a frequent insult must not be traded for rare ones
        often = np.concatenate([often, np.repeat(often[: len(common)], 4) / 4, np.ones(len(negative))])
        share = np.where(y > 0, often / often[y > 0].sum(), often / often[y < 0].sum()) * len(y) / 2
        w, bias = _train_svm(x, y, share)
        alpha = whiten @ w
        flat3, flat4 = np.zeros(LETTERS**3), np.zeros(LETTERS**4)
        for a, f in zip(alpha.tolist(), mark_rows):
            for k, v in f.items():
                if k >= LETTERS**4:
                    flat3[k - LETTERS**4] += a * v
                else:
                    flat4[k] += a * v
        flat3[0] = flat4[0] = 0.0
        model = Model(flat3, flat4, bias, 1.0, 0.0)
        of = dict(zip((all_ := sorted(set().union(*bags))), model.values(all_).tolist())) if any(bags) else {}
        usual = set(lasting)
        witness = {max(b, key=lambda v: (of[v], v)) for b, t in zip(bags, toxic) if t and b and usual.isdisjoint(b)}
        positive = sorted(usual | {w for w in witness if not seen[0][w] and of[w] > 0})
        hard = sorted(seen[0], key=lambda v: (-of[v], v))[: 6 * landmarks]
        negative = sorted(set(negative) | set(hard) - set(positive))
    top = np.array([max((of[w] for w in b), default=model.bias) for b in bags])
    model.slope, model.shift = _logistic(top, toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through labelled values, both kinds weighing alike."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    a = np.stack([x, np.ones_like(x)], 1)
    hold = np.array([1e-4, 1e-6])

    def loss(w):
        z = a @ w
        return float((share * (np.logaddexp(0, z) - target * z)).sum() + (hold * w * w).sum() / 2)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (share * p * (1 - p))[:, None]).T @ a + np.diag(hold)
        step = np.linalg.solve(hess, a.T @ (share * (p - target)) + hold * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def held_out(column: str = "doc_id"):
    """Whether a row's label is kept from training; a missing id is the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """Fit on the bounded sample of labelled training documents with the least id hashes."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id")
    sample = [marked.filter(f"toxic = {k}").orderBy(place, "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    chosen = {r.doc_id: r.toxic for part in sample for r in part.collect()}  # at most toxic + clean ids
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(sorted(chosen), pa.int64())}))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = sorted((r.doc_id, r.text or "") for r in found.groupBy("doc_id").agg(F.min("text").alias("text")).toLocalIterator())
    texts, marks = [t for _, t in rows], np.array([chosen[i] == 1 for i, _ in rows])
    del rows
    model = fit(texts, marks) if texts else None
    del texts
    give_back()  # the driver goes on without what the fit held
    return model


def score(docs: DataFrame, model: Model | None, into: str = "toxicity") -> DataFrame:
    """``docs`` with the score from 0 to 1 in a column named ``into``, to which one of that name gives way; 0 without a model."""
    docs = docs.drop(into)
    out = docs.withColumn(into, F.lit(0.0))
    if model is None:
        return out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    def run(parts):
        known = shared.value
        begin("toxicity", known.known.clear)
        for b in parts:
            found = []
            text = b.column(b.schema.get_field_index("text")).cast(pa.binary())  # a view of the same bytes
            for at in range(0, b.num_rows, 256):
                found.append(known.scores([decode_text(x) for x in raw_values(text.slice(at, 256))]))
            yield b.append_column(into, pa.array(np.concatenate(found) if found else [], pa.float64()))

    return docs.mapInArrow(run, out.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
