"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character;
dynamic programming carries the best score and its piece count, never the pieces. Texts are
cut as a Metaspace pre-tokenizer cuts them (a marker stands for each space and before the
text, a word starts with its marker, line ends stand alone), so a word's count depends on
the word only and repeated words are counted once per worker. Ties go as in the library:
ends are filled from the earliest start on, and a later path wins only if its score is
strictly higher. Characters without a piece score 10 below the lowest piece and count as
their UTF-8 bytes where the vocabulary has byte pieces, else one for a run.

Defined results: null and empty texts have 0 tokens; a very long text is counted whole, word by
word, so no more than it and a word's lattice is held; repeated rows are each returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from anamnesis.llm.common import in_arrow, pick, slices

MARK = "▁"
#: Where the vocabulary lies unless the caller names another file.
VOCABULARY = os.environ.get("ANAMNESIS_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: A worker forgets its words beyond so many.
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Unigram:
    """pieces: (piece, log probability); the first is the unknown piece. byte_fallback: all 256 byte pieces are there."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool

    @property
    def unknown_score(self) -> float:
        return min(s for _, s in self.pieces) - 10.0


def load_unigram(path: str = VOCABULARY) -> Unigram:
    """The vocabulary of a sentencepiece model. A unigram model's scores are log
    probabilities and are used as they are; a BPE model's are ranks, which Zipf's law turns
    into log probabilities. Control pieces are left out; byte pieces get the lowest score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {i: float(model.get_score(i)) for i in plain}
    if all(s == int(s) for s in scores.values()):
        total = math.log(sum(1.0 / (2.7 - s) for s in scores.values()))
        scores = {i: -math.log(2.7 - s) - total for i, s in scores.items()}
    low = min(scores.values())
    raw = [i for i in ids if model.is_byte(i)]
    named = [(model.id_to_piece(i), scores.get(i, low)) for i in [*raw, *plain]]
    return Unigram(((model.id_to_piece(model.unk_id()), low), *named), len(raw) == 256)


class Counter:
    """Counts the pieces of texts under one vocabulary."""

    def __init__(self, vocabulary: Unigram):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.as_bytes = vocabulary.unknown_score, vocabulary.byte_fallback
        self.seen: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        """(pieces, of which bytes or unknown) of one pre-token."""
        n = len(w)
        best, ends = [0.0] * (n + 1), [[] for _ in range(n)]
        for end, found in self.automaton.iter(w):
            ends[end].append(found)
        pieces, unknown, run = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, start, single, known = -math.inf, e - 1, False, True
            for size, score in sorted(ends[e - 1], reverse=True):  # earliest start first
                single = single or size == 1
                if (s := best[e - size] + score) > top:
                    top, start = s, e - size
            if not single and (s := best[e - 1] + self.unknown) > top:
                top, start, known = s, e - 1, False
            best[e] = top
            if known:
                add, miss = 1, 0
            elif self.as_bytes:
                add = miss = len(w[e - 1].encode("utf-8", "surrogatepass"))
            else:
                add = miss = 0 if run[e - 1] else 1
            run[e] = not known
            pieces[e], unknown[e] = pieces[start] + add, unknown[start] + miss
        return pieces[n], unknown[n]

    def part(self, p: str) -> tuple[int, int]:
        """One marker and what follows it up to the next marker; line ends stand alone."""
        total = missed = 0
        for i, line in enumerate((MARK + p).split("\n")):
            for w in ("\n", line) if i else (line,):
                if w:
                    a, b = self.word(w)
                    total, missed = total + a, missed + b
        return total, missed

    def text(self, t: str | None) -> tuple[int, int, int]:
        """(words, pieces, of which bytes or unknown) of a text."""
        if not t:
            return 0, 0, 0
        t = t.replace(" ", MARK)
        parts = (t if t.startswith(MARK) else MARK + t).split(MARK)[1:]
        seen, total, missed = self.seen, 0, 0
        for p in parts:
            got = seen.get(p)
            if got is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                got = self.part(p)
                if len(p) < 64:
                    seen[p] = got
            total += got[0]
            missed += got[1]
        return len(parts), total, missed


_counters: dict[Unigram, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: Unigram) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, n_fallback (bytes or unknown
    pieces among them). One pass over the texts, no shuffle. The vocabulary is broadcast;
    it is a fixed file (tens of thousands of pieces) that does not grow with the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(shared.value)
        if counter is None:
            _counters.clear()
            counter = _counters[shared.value] = Counter(shared.value)
        for b in slices(batches):
            rows = [counter.text(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], names=["doc_id", "n_pretokens", "n_tokens", "n_fallback"])

    return in_arrow(pick(docs, "doc_id", "text"), count, "doc_id long, n_pretokens long, n_tokens long, n_fallback long")
