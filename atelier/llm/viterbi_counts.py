"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position, longest
first; dynamic programming carries, for each position, only the best score and the number
of pieces behind it. Ties keep the piece that begins first, as the tokenizer does. A
character that no piece covers costs the least score less ten; runs of such characters are
one unknown piece, which counts its bytes where the vocabulary has byte pieces.

The scores are the vocabulary's own. VOCABULARY, the only one at hand with scores, is a BPE
model whose scores are ranks, not log probabilities; a unigram model takes its place by name.

White space is handled as the tokenizer's own pre-tokenizer does: a space opens a new unit
that begins with the space mark, and no piece crosses units. Null and empty texts have no
tokens.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Units whose counts one worker remembers, and the longest unit it remembers.
REMEMBERED, LONGEST = 300_000, 64


def load(vocabulary: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, given as a path or a public tokenizer's name."""
    import sentencepiece

    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces; pieces[0] is the unknown piece, <0x00> to <0xFF> are byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=0) or 1
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known = names
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.memory: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Pieces on the best path over one unit. The matches come in step with the positions,
        and only as many positions are held as the longest piece has characters."""
        room = self.longest + 1
        score: list = [0.0] + [None] * self.longest
        count = [0] * room
        open_run = [False] * room  # does the best path to here end in an unknown run?
        known, unknown, fallback = self.known, self.unknown, self.bytes
        matches = self.matches.iter(text)
        last, piece = next(matches, (-1, None))
        pieces = 0
        for at, character in enumerate(text):
            best, pieces, run = None, 0, False
            while last == at:
                length, s = piece
                start = (at + 1 - length) % room
                before = score[start]
                if before is not None and (best is None or before + s > best):
                    best, pieces, run = before + s, count[start] + 1, False
                last, piece = next(matches, (-1, None))
            if character not in known:
                start = at % room
                if score[start] is not None and (best is None or score[start] + unknown > best):
                    best, run = score[start] + unknown, True
                    pieces = count[start] + (len(character.encode()) if fallback else int(not open_run[start]))
            end = (at + 1) % room
            score[end], count[end], open_run[end] = best, pieces, run
        return pieces

    def units(self, text: str | None) -> list[str]:
        """The text's units, without the mark each begins with."""
        if not text:
            return []
        parts = text.split(" ") if " " in text else [text]
        marks = text.replace(" ", MARK) if MARK in text else None
        if marks is not None:
            parts = marks.split(MARK)
        return parts[1:] if (marks or text)[0] in (" ", MARK) else parts

    def __call__(self, text: str | None) -> int:
        total, memory = 0, self.memory
        for u in self.units(text):
            n = memory.get(u)
            if n is None:
                n = self.unit(MARK + u)
                if len(u) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[u] = n
            total += n
        return total


@functools.lru_cache(maxsize=1)
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """The counter of this process: a worker builds an automaton once."""
    return Counter(load(vocabulary))


def count_tokens(docs: DataFrame, text: str = "text", to: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the number of tokens of every whole text; a column of that name is
    replaced."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = counter(vocabulary)
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    return docs.withColumn(to, counted(F.col(text).cast("string")))
