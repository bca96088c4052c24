"""Token counts under a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries, for each character, only the best
score, the number of pieces and whether the last was unknown.  The tie rules
are the tokenizer's own: a later candidate replaces an earlier one only with a
strictly better score, candidates come by their start, a character without a
piece of its own costs ten less than the worst piece, unknown neighbours fuse,
and an unknown stretch is spelt in byte pieces.  A space opens a piece, so a
text is counted word by word and each worker keeps the counts of the words it
has met.

The vocabulary is the public 32k piece list; piece number r scores
``-log(r + 1)``, a fixed rule, as the list holds merge ranks and no
probabilities.

Defined results: null or empty text has 0 tokens and score 0; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import batches, begin, id_and_bytes, raw_values, table
from corpusmill.llm.tokens import decode_text, vocabulary_path

PIECES = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000


def unigram_vocabulary(path: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in id order, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path(PIECES))
    return [(model.id_to_piece(i), -log(i + 1.0)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts pieces of words; ``count`` and ``score`` equal those of the tokenizer's best path."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, remembered: int = REMEMBERED):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        have = {p for p, _ in vocabulary}
        self.all_bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        self.unknown = unknown
        self.remembered = remembered
        self.known: dict[str, tuple[int, float]] = {}

    def _best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a word with its leading space mark; matches come by end, longest and so earliest first."""
        score, count, loose = [0.0], [0], [False]
        at, best, pieces, single = 1, None, 0, False
        unknown, n = self.unknown_score, len(word)

        def close():
            """Settle character ``at``: a candidate of its own start comes last."""
            if not single and (best is None or unknown + score[-1] > best):
                more = len(word[at - 1].encode()) if self.all_bytes else 1 - loose[-1]
                count.append(count[-1] + more)
                score.append(unknown + score[-1])
                loose.append(True)
            else:
                count.append(pieces)
                score.append(best)
                loose.append(False)

        for end, (length, s) in self.automaton.iter(word):
            while at <= end:
                close()
                at, best, single = at + 1, None, False
            candidate = s + score[at - length]
            if best is None or candidate > best:
                best, pieces = candidate, count[at - length] + 1
            if length == 1:
                single = True
        while at <= n:
            close()
            at, best, single = at + 1, None, False
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a whole text."""
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "":
            words = words[1:]  # the text opens with its own space
        count, score, known = 0, 0.0, self.known
        for w in words:
            found = known.get(w)
            if found is None:
                found = self._best(SPACE + w)
                if len(known) >= self.remembered:
                    known = self.known = {}
                known[w] = found
            count += found[0]
            score += found[1]
        return count, score


_counters: dict[str, Counter] = {}


def counter(path: str | None = None) -> Counter:
    """This worker's counter for a piece list."""
    key = path or vocabulary_path(PIECES)
    begin("token_counts", _counters.clear)
    if key not in _counters:
        _counters[key] = Counter(*unigram_vocabulary(key))
    return _counters[key]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens and the best path's score for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(parts):
        count = counter(path).text
        for b in parts:
            texts = [decode_text(x) for x in raw_values(b.column(1))]
            found = [count(t) for t in texts]
            yield batches({"doc_id": b.column(0), "n_chars": [len(t) for t in texts], "n_tokens": [c for c, _ in found], "score": [s for _, s in found]}, schema)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
