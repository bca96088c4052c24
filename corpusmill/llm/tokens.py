"""Token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary's pre-tokenizer parts a text into runs of letters, digits, other
signs and white space, and no merge crosses a run.  The runs of a batch are cut
from its bytes at once, told apart by Arrow's dictionary encoding, and only
distinct runs that a worker does not remember go to the tokenizers library, many
in a call; the ids of the batch are then gathered from the remembered ones.

Where the place of a run's end is open (an apostrophe that may start a
contraction, white space outside ASCII, a character whose class differs between
versions of Unicode, the text of an added token), the stretch between the
nearest certain ends goes to the library as it is.  Ids so equal those of
encoding each text whole by a fresh tokenizer.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa

from corpusmill.llm.common import begin

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Entries of each of the two generations of a worker's memory, and the longest run in it.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes that are cut and gathered at once; a longer text is parted at a certain end of a run.
SLICE_BYTES = 2 << 20
SPACE, BLANK, LETTER, DIGIT, SIGN, OPEN, UNSEEN = range(7)
SPACED, PLAIN, OTHER = range(3)
_END_OF_RUN = re.compile(rb"[0-9A-Za-z](?= )")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def kind_of(point: int) -> int:
    """Class of a character; ``OPEN`` where versions of Unicode or readings of white space differ."""
    c = chr(point)
    if c == " ":
        return SPACE
    if c in "\t\n\v\f\r":
        return BLANK
    now, before = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if c.isspace() or now[0] in "ZC" and point >= 128 or point in range(0x1C, 0x20):
        return OPEN
    kinds = [{"L": LETTER, "N": DIGIT}.get(x[0], SIGN) for x in (now, before)]
    return kinds[0] if kinds[0] == kinds[1] and before != "Cn" else OPEN


class Generation:
    """Remembered runs: the place of each one's ids in a pool."""

    def __init__(self):
        self.slot: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.start, self.length, self.slots = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append ids of consecutive runs and return their slots."""
        for name, more, used in (("pool", len(ids), self.used), ("start", len(lengths), self.slots), ("length", len(lengths), self.slots)):
            have = getattr(self, name)
            if used + more > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(len(have), more), have.dtype)]))
        to = self.slots + len(lengths)
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[self.slots : to] = self.used + np.cumsum(lengths) - lengths
        self.length[self.slots : to] = lengths
        out = np.arange(self.slots, to)
        self.used, self.slots = self.used + len(ids), to
        return out

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slots one after another, and how many each has."""
        lengths = self.length[slots]
        ahead = np.cumsum(lengths)
        total = int(ahead[-1]) if len(ahead) else 0
        return self.pool[np.repeat(self.start[slots] - (ahead - lengths), lengths) + np.arange(total)], lengths


class Encoder:
    """Ids of texts; equal to encoding each text whole."""

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.added = [re.compile(re.escape(t.content.encode())) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(1 << 16, bool)  # tokens that start with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.divider = int(vocabulary[alphabet[10]])
        # in the speller's texts a line end parts runs, and a zero byte is the divider between them
        self.alphabet = "".join({10: " ", 0: alphabet[10]}.get(b) or alphabet.get(b) or chr(b) for b in range(256))
        self.kinds = np.full(0x110000, UNSEEN, np.uint8)
        self.ascii = np.array([kind_of(b) if b < 128 else UNSEEN for b in range(256)], np.uint8)
        self.contracted = np.isin(np.arange(256), np.frombuffer(b"stvmldr", np.uint8))
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        """Let all remembered runs go."""
        self.young, self.old = Generation(), Generation()

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text, encoded whole by the library."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    # Cutting

    def _classes(self, data: np.ndarray) -> np.ndarray:
        kinds = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int32)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
            for k in (1, 2, 3):
                more = np.flatnonzero(size > k)
                point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
            found = self.kinds[point]
            if (found == UNSEEN).any():
                for p in np.unique(point[found == UNSEEN]).tolist():
                    self.kinds[p] = kind_of(p)
                found = self.kinds[point]
            for k in range(4):
                more = np.flatnonzero(size > k) if k > 1 else slice(None)
                kinds[lead[more] + k] = found[more]
        return kinds

    def _runs(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the runs of the texts that begin at ``starts``, and whether each is spaced, plain or other."""
        n, kinds = len(data), self._classes(data)
        word = kinds > BLANK
        cut = np.zeros(n + 1, bool)
        before, now = kinds[:-1], kinds[1:]
        # a run of words ends where the class changes; a space goes with the word after it, other white space does not
        cut[1:n] = (before != now) & (word[:-1] | (word[1:] & (before != SPACE)))
        # the last of several blanks before a word stands apart from those ahead of it
        last = np.flatnonzero(~word[:-2] & ~word[1:-1] & word[2:]) + 1
        cut[last] = True
        fresh = np.zeros(n + 1, bool)
        fresh[starts] = fresh[0] = fresh[n] = True
        cut[last[fresh[last + 1]]] = False  # but not at the end of a text
        cut |= fresh
        mark = np.flatnonzero(data[:-1] == 39)
        mark = mark[self.contracted[data[mark + 1]]]
        spans = [m.span() for p in self.added for m in p.finditer(data)]
        doubtful = np.concatenate([np.flatnonzero(kinds == OPEN), mark, *([s, e - 1] for s, e in spans)]).astype(np.int64)
        if len(doubtful):
            sure = fresh.copy()
            sure[1:n] |= word[:-1] & (before != OPEN) & ~word[1:]
            at = np.flatnonzero(sure)
            place = np.searchsorted(at, doubtful, side="right")
            inside = np.zeros(n + 2, np.int32)
            np.add.at(inside, at[place - 1] + 1, 1)
            np.add.at(inside, at[place], -1)
            cut &= np.cumsum(inside)[: n + 1] == 0
            for s, e in spans:  # an added token may hold certain ends, none of which parts it
                cut[s + 1 : e] = fresh[s + 1 : e]
        cuts = np.flatnonzero(cut)
        first, second = kinds[cuts[:-1]], kinds[np.minimum(cuts[:-1] + 1, n - 1)]
        group = np.where((first == SPACE) & (second == LETTER), SPACED, np.where(first == LETTER, PLAIN, OTHER)).astype(np.int8)
        group[np.searchsorted(cuts, doubtful, side="right") - 1] = OTHER
        return cuts, group

    # Learning

    def _spelt(self, parts: list[bytes], joint: bytes) -> np.ndarray:
        text = codecs.charmap_decode(joint.join(parts), "strict", self.alphabet)[0]
        return np.array(self.speller.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _spaced(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of runs of a space and letters: only their first tokens start with a space."""
        ids = np.concatenate([self._spelt(words[at : at + 64], b"\n") for at in range(0, len(words), 64)])
        first = np.flatnonzero(self.opens[ids])
        return ids, np.diff(first, append=len(ids))

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of runs of letters, which a divider keeps apart."""
        ids = np.concatenate([np.append(self._spelt(words[at : at + 64], b"\n\0\n"), np.uint16(self.divider)) for at in range(0, len(words), 64)])
        stop = np.flatnonzero(ids == self.divider)
        return ids[ids != self.divider], np.diff(stop, prepend=-1) - 1

    def _other(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint16), np.array([len(x) for x in found], np.int64)

    def _learn(self, words: list[bytes], at: np.ndarray, group: np.ndarray, slots: np.ndarray) -> None:
        """Encode the runs ``words[at]`` and put their slots down; long ones come last and are not remembered."""
        own = self.young
        long = np.array([len(words[i]) > LONGEST for i in at.tolist()], bool)
        for kind, encode in ((SPACED, self._spaced), (PLAIN, self._plain), (OTHER, self._other)):
            chosen = at[(group[at] == kind) & ~long]
            if len(chosen):
                part = [words[i] for i in chosen.tolist()]
                slots[chosen] = new = own.add(*encode(part))
                own.slot.update(zip(part, new.tolist()))
        self.kept = own.used, own.slots
        for i in at[long].tolist():  # one at a time: such a run may be a whole text
            slots[i] = own.add(*self._other([words[i]]))[0]

    def _slots(self, words: list[bytes], group: np.ndarray) -> np.ndarray:
        own, old = self.young, self.old
        slots = np.array(list(map(own.slot.get, words, repeat(-1))), np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing) and old.slot:
            before = np.array(list(map(old.slot.get, [words[i] for i in missing.tolist()], repeat(-1))), np.int64)
            met = missing[before >= 0]
            slots[met] = own.add(*old.gather(before[before >= 0]))
            own.slot.update(zip([words[i] for i in met.tolist()], slots[met].tolist()))
            missing = missing[before < 0]
        self.kept = own.used, own.slots
        if len(missing):
            self._learn(words, missing, group, slots)
        return slots

    # Encoding

    def _slice(self, raw: pa.Buffer, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``starts`` of some bytes, and where each text's ids begin."""
        if len(self.young.slot) > self.remembered:
            self.old, self.young = self.young, Generation()
        data = np.frombuffer(raw, np.uint8)
        cuts, group = self._runs(data, starts[starts < len(data)])
        runs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), raw]).dictionary_encode()
        number = runs.indices.to_numpy()
        kind = np.zeros(len(runs.dictionary), np.int8)
        kind[number] = group
        slots = self._slots(runs.dictionary.to_numpy(zero_copy_only=False).tolist(), kind)
        ids, lengths = self.young.gather(slots[number])
        self.young.used, self.young.slots = self.kept
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(cuts, starts)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of UTF-8 bytes, and their bounds: text k has ids[bounds[k]:bounds[k + 1]]; null is empty."""
        column = readable(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        body = column.buffers()[2]
        found, bounds, total, k, n = [], [], 0, 0, len(column)
        while k < n:
            to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE_BYTES, side="right")) - 1)
            begin_, end = int(offsets[k]), int(offsets[to])
            starts = offsets[k:to] - begin_
            if end == begin_:
                bounds.append(np.full(to - k, total))
            elif end - begin_ <= SLICE_BYTES:
                ids, first = self._slice(body.slice(begin_, end - begin_), starts)
                found.append(ids)
                bounds.append(first + total)
                total += len(ids)
            else:  # one long text
                bounds.append(np.array([total]))
                for s, e in self._parts(body, begin_, end):
                    found.append(self._slice(body.slice(s, e - s), np.zeros(1, np.int64))[0])
                    total += len(found[-1])
            k = to
        bounds.append(np.array([total]))
        return np.concatenate(found) if found else np.zeros(0, np.uint16), np.concatenate(bounds).astype(np.int64)

    def _parts(self, body: pa.Buffer, at: int, end: int):
        """Stretches of one long text that end where a run surely ends, outside added tokens."""
        longest = max((len(p.pattern) for p in self.added), default=0)
        while at < end:
            stop = at + SLICE_BYTES
            while stop < end:
                found = _END_OF_RUN.search(body, stop, end)
                stop = found.end() if found else end
                low = max(at, stop - longest)
                near = bytes(body[low : min(end, stop + longest)])
                if not any(m.start() < stop - low < m.end() for p in self.added for m in p.finditer(near)):
                    break
            yield at, (stop := min(stop, end))
            at = stop


def readable(column: pa.Array) -> pa.Array:
    """The column as bytes of well-formed UTF-8; malformed bytes become U+FFFD."""
    try:
        return column.cast(pa.string()).cast(pa.binary())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace").encode() for x in column.cast(pa.binary()).to_pylist()], pa.binary())


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = path or vocabulary_path()
    begin("tokens", _encoders.clear)
    if key not in _encoders:
        _encoders[key] = Encoder(key)
    return _encoders[key]


def decode_text(raw: bytes | None) -> str:
    """The text of UTF-8 bytes; null is empty, malformed bytes become U+FFFD."""
    return raw.decode("utf-8", "replace") if raw else ""
