"""Language-model scores by online logistic context mixing.

A text is the sequence of its words, lower-cased in A-Z, and one end. A token is spelled in
the bits of a Huffman code: common words have codes of their own, all others an escape and
the codes of their bytes. Four hashed contexts predict every bit: what is spelled of the word
so far; that and the word before; the last three bytes, which at a word's start are the end
of the word before; and that of the second context again, as counted in this text alone. The
first three start from the counts of all training documents, the last learns as the text goes.

The predictions are mixed in the logistic domain. A weight set, chosen by the kind of the bit
and by how sure the second context is, sums the stretched probabilities; each text adds
corrections of its own to the weights, which follow the gradient of the coding cost. A last
stage refines the mixed probability by what bits of its kind and size have come to in this
text so far. Counters, corrections and refinement move after every BLOCK tokens, so a bit is
only ever predicted from what stands before it. The cost of a text is its number of bits.

Training statistics grow with the corpus - the counts of all words, then the counts of all
hashed contexts over all texts - and end in tables with at least as many slots as there are
bits, up to MOST_BITS that a task can hold. Words inside no training document still have a
probability. A null text is an empty one: its single token is the end. A null key is in the
training fold.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import written

#: Least and most log2 of the slots of each context's table.
LEAST_BITS, MOST_BITS = 16, 22
#: Slots of one row of the gathered table.
ROW = 1 << 16
#: Most common words, and how often each is counted at least: they have codes of their own.
COMMON, OFTEN = 1 << 16, 3
#: Tokens after which everything learns; tokens that go forward together; bytes read at a time.
BLOCK, TOGETHER, READ = 16, 1 << 15, 1 << 22
#: Tasks whose counts of contexts are added up together, before these sums are.
FAN = 256
#: Words that are spelled at a time, and distinct words a task counts before it hands them on.
SPELLED, HELD = 1 << 13, 400_000
#: Kinds of bits: of a common word, of a spelled one, of a spelled one's first byte.
KINDS = 3
#: A count of ones and zeros is PRIOR more of both, and is stretched to steps of 1 / SCALE.
PRIOR, SCALE = 0.3, 14.0
#: The steps from which the second context is a little, well, and very sure.
SURE = np.searchsorted([1, 21, 56], np.abs(np.arange(256).astype(np.uint8).view(np.int8).astype(np.int16)), side="right").astype(np.uint8)
LEVELS = 4
#: First weights of the four contexts and an offset: a column for each kind and sureness.
WEIGHTS = np.array(
    [
        [0.45, 0.45, 0.3, 1.3, 0.4, 0.4, 0.0, 0.45, 0.4, 0.35, 0.4, 0.6],
        [0.0, 0.5, 0.4, 0.55, 0.0, 0.25, 0.25, 0.35, 0.0, 0.3, 0.25, 0.3],
        [0.25, 0.3, 0.4, 0.8, 0.6, 0.55, 0.55, 0.85, 0.5, 0.5, 0.55, 0.55],
        [0.1, 0.1, 0.15, 0.15, 0.15, 0.15, 0.2, 0.35, 0.15, 0.2, 0.2, 0.2],
        [0.0, 0.0, 0.0, 0.0, -0.05, -0.05, -0.05, 0.0, 0.0, 0.0, -0.05, 0.15],
    ],
    np.float32,
)
RATE = np.float32(0.003)
#: A text's own counts, up to 15 of zeros and of ones, stretched; slots of a text, at most.
COUNTED = np.log((np.arange(16)[None, :] + 0.4) / (np.arange(16)[:, None] + 0.4)).astype(np.float32).reshape(-1)
MOST_ROOM = 1 << 20
#: The last stage: stretched probabilities to LIMIT in BUCKETS, each worth STIFF counts.
LIMIT, STIFF, FLOOR = 16, np.float32(24), np.float32(3e-7)
BUCKETS = 2 * LIMIT + 1
CENTRES = (1 / (1 + np.exp(-np.arange(-LIMIT, LIMIT + 1)))).astype(np.float32)
END = b"\n"
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: str, folds: int = 7, fold: int = 2) -> Column:
    """Is the row one that training must not see? A null key is none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word (bytes) and n of every token of docs."""

    def count(batches):
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for t in batch.column(0):
                held.update(tokens(t.as_py()))
                if len(held) > HELD:
                    yield out()
        yield out()

    partial = docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 32-bit hashes of 64-bit numbers, in wrapping arithmetic."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    return ((x ^ (x >> np.uint64(29))) * MIX >> np.uint64(32)).astype(np.uint32)


def _huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """length of each symbol's code, and the inner nodes and bits of all codes in a row."""
    if len(counts) == 1:
        return np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    heap = [(c, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    node, above = len(counts) - 1, {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        node += 1
        above[a[2]], above[b[2]] = (node, 0), (node, 1)
        heapq.heappush(heap, (a[0] + b[0], node, node))
    lengths, nodes, bits = [], [], []
    for s in range(len(counts)):
        path = []
        while s in above:
            s, bit = above[s]
            path.append((s - len(counts), bit))
        lengths.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return np.array(lengths, np.int64), np.array(nodes, np.uint32), np.array(bits, np.uint8)


@dataclass
class Events:
    """The bits of some distinct words, one word after the other: their values, kinds
    (0: of a common word, 1: of a spelled one, 2: of its first byte), hashes of the word so far and
    of its last bytes, each with the node; and where each word's bits start, how many they are,
    and hashes of the word and its end, by which it is a context of the next."""

    bit: np.ndarray
    kind: np.ndarray
    so_far: np.ndarray
    last: np.ndarray
    start: np.ndarray
    size: np.ndarray
    word: np.ndarray
    end: np.ndarray


class Code:
    """A Huffman code of tokens: common words have codes of their own, all others an escape
    and the codes of their bytes and a space."""

    def __init__(self, common: list[tuple[bytes, int]], rest: int, spelled: np.ndarray):
        """common: words and their counts; rest: tokens of other words; spelled: their bytes."""
        self.ids = {w: i for i, (w, _) in enumerate(common)}
        self.escape = len(common)
        self.length, self.node, self.bit = _huffman([*(n for _, n in common), rest + 1])
        self.base = np.cumsum(self.length) - self.length
        self.byte_length, nodes, self.byte_bit = _huffman([int(c) + 1 + int(spelled.sum()) // 20_000 for c in spelled])
        self.byte_node = nodes + np.uint32(len(common) + 1)
        self.byte_base = np.cumsum(self.byte_length) - self.byte_length
        bits = self.trained_bits(common, rest, spelled).bit_length()
        self.fit((min(MOST_BITS, max(LEAST_BITS, bits)),) * 3)

    def trained_bits(self, common: list[tuple[bytes, int]], rest: int, spelled: np.ndarray) -> int:
        """How many bits the counted tokens have."""
        coded = sum(n * int(size) for (_, n), size in zip(common, self.length))
        return coded + rest * int(self.length[self.escape]) + int((spelled * self.byte_length).sum())

    def fit(self, tables: tuple[int, ...]) -> None:
        """Give the contexts' tables so many bits."""
        self.tables = tables
        self.offsets = [0, *np.cumsum([1 << b for b in tables]).tolist()]
        self.slots = self.offsets[-1]

    def events(self, words: list[bytes]) -> Events:
        """The events of words, made from SPELLED of them at a time."""
        parts = [self._events(words[i : i + SPELLED]) for i in range(0, len(words), SPELLED)]
        if len(parts) == 1:
            return parts[0]
        # one field after the other, so that the parts and the whole are not held at once
        whole = Events(*(np.concatenate([p.__dict__.pop(f.name) for p in parts]) for f in fields(Events)))
        whole.start = np.cumsum(whole.size) - whole.size
        return whole

    def _events(self, words: list[bytes]) -> Events:
        ids = np.fromiter((self.ids.get(w, self.escape) for w in words), np.int64, len(words))
        spelled = np.flatnonzero(ids == self.escape)
        pieces = [words[i] + b" " for i in spelled]
        s = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = s.astype(np.uint64)
        last = np.zeros(len(s), np.uint64)
        for k in (1, 2, 3):
            before = np.concatenate([np.zeros(k, np.uint64), wide])[: len(s)]
            last |= np.where(place >= k, before + np.uint64(1), np.uint64(0)) << np.uint64(9 * k)
        # a polynomial of the bytes before, from the word's start
        r, inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * np.cumprod(np.full(len(s), inverse)))])
        begun = (sums[:-1] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)) * np.cumprod(np.full(len(s), r))
        # bits of the bytes, then of the common codes and escapes, put in the words' order
        n_bits = self.byte_length[s]
        byte_at = np.repeat(self.byte_base[s] - (np.cumsum(n_bits) - n_bits), n_bits) + np.arange(int(n_bits.sum()))
        head = self.length[ids]
        tail = np.zeros(len(words), np.int64)
        if len(spelled):
            tail[spelled] = np.add.reduceat(n_bits, np.cumsum(sizes) - sizes)
        size = head + tail
        start = np.cumsum(size) - size
        total = int(size.sum())
        node, bit, kind = np.zeros(total, np.uint64), np.zeros(total, np.uint8), np.zeros(total, np.uint8)
        so_far, last_of = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        to = np.repeat(start - (np.cumsum(head) - head), head) + np.arange(int(head.sum()))
        at = np.repeat(self.base[ids] - (np.cumsum(head) - head), head) + np.arange(int(head.sum()))
        node[to], bit[to] = self.node[at], self.bit[at]
        n_tail = tail[spelled]
        to = np.repeat(start[spelled] + head[spelled] - (np.cumsum(n_tail) - n_tail), n_tail) + np.arange(int(n_tail.sum()))
        node[to], bit[to] = self.byte_node[byte_at], self.byte_bit[byte_at]
        kind[to] = np.repeat(np.where(place == 0, 2, 1).astype(np.uint8), n_bits)
        so_far[to], last_of[to] = np.repeat(begun, n_bits), np.repeat(last, n_bits)
        whole = np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words)) * MIX
        ends = np.fromiter((zlib.crc32(w[-3:]) for w in words), np.uint64, len(words)) * MIX
        node *= np.uint64(0xD6E8FEB86659FD93)
        return Events(bit, kind, mixed(so_far * MIX + node), mixed(last_of * MIX + node + np.uint64(1)), start, size, (whole >> np.uint64(32)).astype(np.uint32), (ends >> np.uint64(32)).astype(np.uint32))


class Stream:
    """The bits of some tokens, in the order in which they are coded. n, ends: how many each
    token has, summed up; at: where each bit is in the distinct words' events; one, two:
    hashes of its contexts across words."""

    def __init__(self, events: Events, words: np.ndarray, before: np.ndarray):
        n = events.size[words]
        self.n, self.ends = n, np.cumsum(n)
        self.at = np.repeat(events.start[words] - (self.ends - n), n)
        self.at += np.arange(len(self.at))
        self.kind = events.kind[self.at]
        self.one = (np.repeat(events.word[before], n) ^ events.so_far[self.at]) * np.uint32(0x9E3779B1)
        # later bytes of a spelled word follow its own last bytes, the rest the word before
        self.two = np.where(self.kind == 1, 0, np.repeat(events.end[before], n)).astype(np.uint32)
        self.two ^= events.last[self.at]
        self.two *= np.uint32(0x85EBCA6B)


def distinct_of(texts: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """The distinct words of some texts, and for each text its words and the words before
    them as places among these. Before the first word stands the end of another text."""
    ids: dict[bytes, int] = {END: 0}
    words = [np.fromiter((ids.setdefault(w, len(ids)) for w in t), np.int64, len(t)) for t in texts]
    return list(ids), words, [np.concatenate([[0], w[:-1]]) for w in words]


def count_batch(texts: list[list[bytes]], code: Code, counts: np.ndarray) -> int:
    """Add the bits of texts to the counts of zeros and ones of all slots; how many were added."""
    distinct, words, before = distinct_of(texts)
    events = code.events(distinct)
    flat, prior = np.concatenate(words), np.concatenate(before)
    often = np.bincount(flat, minlength=len(distinct))
    first, one, two = (32 - b for b in code.tables)
    for lo in range(0, len(distinct), SPELLED):
        size = events.size[lo : lo + SPELLED]
        own = slice(int(events.start[lo]), int(events.start[lo] + size.sum()))
        at = (events.so_far[own] >> np.uint32(first)).astype(np.int64) * 2 + events.bit[own]
        np.add.at(counts, at, np.repeat(often[lo : lo + SPELLED].astype(counts.dtype), size))
    for lo in range(0, len(flat), SPELLED):
        s = Stream(events, flat[lo : lo + SPELLED], prior[lo : lo + SPELLED])
        bit = events.bit[s.at]
        for hashes, shift, offset in ((s.one, one, code.offsets[1]), (s.two, two, code.offsets[2])):
            at = (hashes >> np.uint32(shift)).astype(np.int64)
            at += offset
            at <<= 1
            at += bit
            np.add.at(counts, at, counts.dtype.type(1))
    return int((often * events.size).sum())


def stretched(counts: np.ndarray) -> np.ndarray:
    """The logarithm of the odds of a one, in steps of 1 / SCALE."""
    odds = np.log((counts[:, 1] + PRIOR) / (counts[:, 0] + PRIOR))
    return np.clip(np.round(odds * SCALE), -127, 127).astype(np.int8)


def score_batch(texts: list[list[bytes]], code: Code, table: np.ndarray) -> np.ndarray:
    """Coding cost of each token list in bits. Texts of like length go forward together."""
    distinct, words, before = distinct_of(texts)
    events = code.events(distinct)
    first = table[events.so_far >> np.uint32(32 - code.tables[0])]
    cost = np.zeros(len(texts))
    order = np.argsort([len(w) for w in words], kind="stable")
    sizes = np.cumsum([len(words[d]) for d in order])
    for group in np.split(order, np.flatnonzero(np.diff(sizes // TOGETHER)) + 1):
        cost[group] = _mix([words[d] for d in group], [before[d] for d in group], events, first, code, table)
    return cost


def _mix(words: list[np.ndarray], before: list[np.ndarray], events: Events, first: np.ndarray, code: Code, table: np.ndarray) -> np.ndarray:
    """Coding cost of each text, given as its words and the words before them, the shortest
    first. Each has its own corrections, counters and refinement; about TOGETHER tokens have
    their bits laid out at a time, whatever the texts' length."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    block = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // BLOCK
    order = np.argsort(block, kind="stable")
    doc = np.repeat(np.arange(n), lengths)[order]
    words, before = np.concatenate(words)[order], np.concatenate(before)[order]
    edges = np.concatenate([[0], np.cumsum(np.bincount(block))])
    # a text's own counters have at least eight slots for a token, up to MOST_ROOM
    room = np.minimum(np.int64(1) << (8 + np.ceil(np.log2(np.maximum(lengths / 32, 1))).astype(np.int64)), MOST_ROOM)
    state = _State(np.cumsum(room) - room, (room - 1).astype(np.uint32), np.zeros(2 * int(room.sum()), np.int32),
                   np.zeros((len(WEIGHTS), n), np.float32), np.zeros(2 * n * KINDS * BUCKETS, np.int32), np.zeros(n))
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + TOGETHER, side="right")) - 1)
        own = slice(int(edges[at]), int(edges[to]))
        _forward(Stream(events, words[own], before[own]), doc[own], (edges[at : to + 1] - edges[at]).tolist(), events.bit, first, code, table, state)
        at = to
    return state.cost


@dataclass
class _State:
    """What some texts have learnt: where each has its counters and how many, the counts of
    zeros and ones in these, corrections of the weights, the refinement's counts, the cost."""

    base: np.ndarray
    mask: np.ndarray
    seen: np.ndarray
    moved: np.ndarray
    refined: np.ndarray
    cost: np.ndarray


def _forward(s: Stream, doc: np.ndarray, edges: list[int], bits: np.ndarray, first: np.ndarray, code: Code, table: np.ndarray, state: _State) -> None:
    """Code the tokens of s, doc being the text each is of and edges where blocks begin."""
    bit = bits[s.at]
    one = table[code.offsets[1] :][s.one >> np.uint32(32 - code.tables[1])]
    two = table[code.offsets[2] :][s.two >> np.uint32(32 - code.tables[2])]
    inputs = [part * np.float32(1 / SCALE) for part in (first[s.at], one, two)]
    gate = s.kind * np.uint8(LEVELS) + SURE[one.view(np.uint8)]
    mixed_all = WEIGHTS[-1][gate]
    for x, w in zip(inputs, WEIGHTS):
        mixed_all += w[gate] * x
    own_weight = WEIGHTS[-2][gate]
    of = np.repeat(doc, s.n)
    slot = (s.one & state.mask[of]) + state.base[of]
    cell = (of * KINDS + s.kind) * BUCKETS
    for a, b in zip(edges, edges[1:]):
        lo, hi = int(s.ends[a] - s.n[a]), int(s.ends[b - 1])
        own = slice(lo, hi)
        starts = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        docs, heads = doc[a:b][starts], (s.ends[a:b] - s.n[a:b])[starts] - lo
        per = np.diff(heads, append=hi - lo)
        hits = slot[own] * 2
        counted = COUNTED[np.minimum(state.seen[hits], 15) * 16 + np.minimum(state.seen[hits + 1], 15)]
        x = [part[own] for part in inputs] + [counted]
        z = mixed_all[own] + own_weight[own] * counted
        for moved, part in zip(state.moved, x):
            z += np.repeat(moved[docs], per) * part
        z += np.repeat(state.moved[-1][docs], per)
        np.clip(z, -LIMIT, LIMIT, out=z)
        p = 1 / (1 + np.exp(-z))
        bucket = np.rint(z + np.float32(LIMIT)).astype(np.int32)
        at = (cell[own] + bucket) * 2
        zeros, ones = state.refined[at], state.refined[at + 1]
        guess = CENTRES[bucket]
        final = p + np.float32(0.5) * ((ones + STIFF * guess) / (zeros + ones + STIFF) - guess)
        value = bit[own]
        np.subtract(1, final, out=final, where=value == 0)
        np.clip(final, FLOOR, 1 - FLOOR, out=final)
        state.cost[docs] -= np.add.reduceat(np.log2(final), heads, dtype=np.float64)
        miss = (value - p) * RATE
        for moved, part in zip(state.moved, x):
            moved[docs] += np.add.reduceat(miss * part, heads)
        state.moved[-1][docs] += np.add.reduceat(miss, heads)
        np.add.at(state.seen, hits + value, np.int32(1))
        np.add.at(state.refined, at + value, np.int32(1))


def byte_counts(words: DataFrame, coded: set[bytes]) -> tuple[int, np.ndarray]:
    """Of the words that are not coded as a whole: their tokens, and how often each byte is
    spelled in them."""
    known = words.sparkSession.sparkContext.broadcast(coded)

    def count(batches):
        tokens, total = 0, np.zeros(256, np.int64)
        for batch in batches:
            rest = [(w + b" ", n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in known.value]
            if rest:
                n = np.repeat([n for _, n in rest], [len(w) for w, _ in rest])
                total += np.bincount(np.frombuffer(b"".join(w for w, _ in rest), np.uint8), n, 256).astype(np.int64)
                tokens += sum(n for _, n in rest)
        columns = [pa.array(range(-1, 256), pa.int32()), pa.array([tokens, *total.tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["byte", "n"])

    found = words.select("word", "n").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = {r.byte: r.n for r in found}
    return counts.get(-1, 0), np.array([counts.get(b, 0) for b in range(256)], np.int64)


def _read(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and tokens of the texts of a batch, about READ bytes at a time."""
    lo = 0
    while lo < batch.num_rows:
        texts, held = [], 0
        while lo + len(texts) < batch.num_rows and (held < READ or not texts):
            data = batch.column(column)[lo + len(texts)].as_py() or b""
            texts.append(tokens(data))
            held += len(data)
        yield lo, texts
        lo += len(texts)


def context_table(docs: DataFrame, text: str, code: Code) -> np.ndarray:
    """The stretched probability of a one in every slot, from all texts of docs. The
    counts are added up in two steps, of FAN tasks each and over these, so that no task reads
    what every other has counted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(code)

    def count(batches):
        code = shared.value
        held, full = np.zeros((code.slots, 2), np.uint32), 0
        group = TaskContext.get().partitionId() // FAN

        def out():
            for row in range(0, code.slots, ROW):
                if held[row : row + ROW].any():
                    packed = zlib.compress(held[row : row + ROW].tobytes(), 1)
                    columns = [pa.array([row // ROW], pa.int32()), pa.array([group], pa.int32()), pa.array([packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "group", "counts"])

        for batch in batches:
            for _, texts in _read(batch, 0):
                full += count_batch(texts, code, held.reshape(-1))
                if full >= 1 << 31:  # so that no count outgrows its 32 bits
                    yield from out()
                    held[:], full = 0, 0
        yield from out()

    def added(number: type, give: Callable[[np.ndarray], bytes]):
        """Adds up the packed counts of a group, which are of this type, and gives their sums."""

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((ROW, 2), np.int64)
            for batch in batches:
                for c in batch.column("counts"):
                    part = np.frombuffer(zlib.decompress(c.as_py()), number).reshape(-1, 2)
                    total[: len(part)] += part
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([give(total)], pa.binary())], names=["row", "counts"])

        return add

    partial = docs.select(F.col(text).cast("binary")).mapInArrow(count, "row int, group int, counts binary")
    some = partial.groupBy("row", "group").applyInArrow(added(np.uint32, lambda t: zlib.compress(t.tobytes(), 1)), "row int, counts binary")
    whole = some.groupBy("row").applyInArrow(added(np.int64, lambda t: stretched(t).tobytes()), "row int, counts binary")
    table = np.zeros(-(-code.slots // ROW) * ROW, np.int8)
    for r in whole.collect():
        table[r.row * ROW : (r.row + 1) * ROW] = np.frombuffer(r.counts, np.int8)
    return table[: code.slots]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    model's probability) and bits_per_byte of every text; training reads the rows that are
    not held out."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    training = docs.where(~held_out("k"))
    vocabulary = written(count_words(training, "t"), "vocabulary")
    totals = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    common = [(bytes(r.word), r.n) for r in vocabulary.orderBy(F.desc("n"), "word").limit(COMMON).collect()]
    coded = [(w, n) for w, n in common if n >= OFTEN and w != END] + [(END, dict(common).get(END, 1))]
    code = Code(coded, *byte_counts(vocabulary, {w for w, _ in coded}))
    table = context_table(training, "t", code)
    shared = spark.sparkContext.broadcast((code, table, {w: log10(n + 1) for w, n in common}))
    kind = docs.schema["k"].dataType.simpleString()
    schema = f"k {kind}, row long, n_tokens long, n_common long, common double, bits double, bytes long, words array<binary>, ns array<int>"

    def rate(batches):
        code, table, logs = shared.value
        for batch in batches:
            for lo, texts in _read(batch, 2):
                rows = []
                for t, bits in zip(texts, score_batch(texts, code, table)):
                    known = [logs[w] for w in t if w in logs]
                    rest = Counter(w for w in t if w not in logs) if len(known) < len(t) else {}
                    rows.append((len(t), len(known), sum(known), bits, sum(map(len, t)) + len(t) - 1, list(rest), list(rest.values())))
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                part = batch.slice(lo, len(texts))
                names = ["k", "row", "n_tokens", "n_common", "common", "bits", "bytes", "words", "ns"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    numbered = docs.select("k", F.monotonically_increasing_id().alias("row"), F.col("t").cast("binary").alias("t"))
    rated = written(numbered.mapInArrow(rate, schema), "rated")
    rare = rated.select("row", F.explode(F.arrays_zip("words", "ns")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.ns").alias("m"))
    found = rare.join(vocabulary, "word").groupBy("row").agg(F.sum("m").alias("n_rare"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("rare"))
    whole = log10(totals.n + totals.v + 1)
    return rated.drop("words", "ns").join(found, "row", "left").select(
        F.col("k").alias(key), held_out("k").alias("held_out"), "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        (F.col("common") + F.coalesce("rare", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        (-F.col("bits") * log10(2)).alias("score"),
        (F.col("bits") / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
