import os
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from atelier.llm import mix_lm as m


def slow_tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + ["\n"]


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def slow_base(rows):
    counts = Counter(w for d, t in rows if not is_held(d) for w in slow_tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (len(slow_tokens(t)), sum(w in counts for w in slow_tokens(t)), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in slow_tokens(t))) for d, t in rows}


def slow_bits(word, before, code):
    """(value, kind, hash of the word so far, of the context across words, of the last bytes)."""
    wide, narrow = (1 << 64) - 1, (1 << 32) - 1

    def mixed(x):
        x = (x ^ x >> 31) * int(m.MIX) & wide
        return ((x ^ x >> 29) * int(m.MIX) & wide) >> 32

    crc = lambda w: (zlib.crc32(w) * int(m.MIX) & wide) >> 32
    symbol = code.ids.get(word, code.escape)
    steps = [(code.node[i], code.bit[i], 0, b"") for i in range(code.base[symbol], code.base[symbol] + code.length[symbol])]
    if symbol == code.escape:
        for place, c in enumerate(word + b" "):
            at = range(code.byte_base[c], code.byte_base[c] + code.byte_length[c])
            steps += [(code.byte_node[i], code.byte_bit[i], 1 if place else 2, (word + b" ")[:place]) for i in at]
    for node, bit, kind, held in steps:
        node = int(node) * 0xD6E8FEB86659FD93
        begun = sum((c + 1) * pow(0x5851F42D4C957F2D, len(held) - i, 1 << 64) for i, c in enumerate(held))
        last = sum((c + 1) << 9 * (k + 1) for k, c in enumerate(held[::-1][:3]))
        so_far, near = mixed(begun * int(m.MIX) + node & wide), mixed(last * int(m.MIX) + node + 1 & wide)
        one = (crc(before) ^ so_far) * 0x9E3779B1 & narrow
        two = ((0 if kind == 1 else crc(before[-3:])) ^ near) * 0x85EBCA6B & narrow
        yield int(bit), kind, (so_far, one, two)


def slow_table(texts, code):
    counts = Counter()
    for t in texts:
        for before, w in zip([m.END, *t], t):
            for bit, _, hashes in slow_bits(w, before, code):
                counts.update((k, h >> 32 - code.tables[k], bit) for k, h in enumerate(hashes))
    return lambda k, h: float(np.clip(np.round(np.log((counts[k, h >> 32 - code.tables[k], 1] + m.PRIOR) / (counts[k, h >> 32 - code.tables[k], 0] + m.PRIOR)) * m.SCALE), -127, 127)) / m.SCALE


def slow_cost(tokens, code, stretch):
    """One text, one bit after another; what is learnt takes effect with the next block."""
    room = 1 << 8 + int(np.ceil(np.log2(max(len(tokens) / 32, 1))))
    weights, seen, refined, cost, learnt = m.WEIGHTS.astype(float), Counter(), Counter(), 0.0, []
    for i, w in enumerate(tokens):
        if i % m.BLOCK == 0:
            for slot, cell, bit, step in learnt:
                seen[slot, bit] += 1
                refined[cell, bit] += 1
                weights = weights + step[:, None]
            learnt = []
        for bit, kind, hashes in slow_bits(w, tokens[i - 1] if i else m.END, code):
            x = [stretch(k, h) for k, h in enumerate(hashes)]
            slot = hashes[1] & room - 1
            x += [np.log((min(seen[slot, 1], 15) + 0.4) / (min(seen[slot, 0], 15) + 0.4)), 1.0]
            sure = sum(abs(x[1]) * m.SCALE > e - 0.5 for e in (1, 21, 56))
            z = float(np.clip(np.dot(weights[:, kind * 4 + sure], x), -16, 16))
            p = 1 / (1 + np.exp(-z))
            bucket = round(z)
            guess = 1 / (1 + np.exp(-bucket))
            ones, both = refined[(kind, bucket), 1], refined[(kind, bucket), 0] + refined[(kind, bucket), 1]
            final = p + 0.5 * ((ones + m.STIFF * guess) / (both + m.STIFF) - guess)
            cost -= np.log2(np.clip(final if bit else 1 - final, m.FLOOR, 1 - m.FLOOR))
            learnt.append((slot, (kind, bucket), bit, m.RATE * (bit - p) * np.array(x)))
    return cost


TEXTS = [m.tokens(t.encode()) for t in ("the cat sat on the mat " * 9, "", "the dog é sat", "a new zebra sat on a mat " * 30, "the cat")]


def fitted(texts):
    counts = Counter(w for t in texts for w in t)
    coded = [(w, n) for w, n in counts.items() if n >= 3 and w != m.END] + [(m.END, max(1, counts[m.END]))]
    rest = {w: n for w, n in counts.items() if w not in dict(coded)}
    spelled = sum((n * np.bincount(np.frombuffer(w + b" ", np.uint8), minlength=256) for w, n in rest.items()), np.zeros(256, np.int64))
    return m.Code(coded, sum(rest.values()), spelled)


def test_whole_score_one_bit_after_another(monkeypatch):
    code = fitted(TEXTS)
    counts = np.zeros((code.slots, 2), np.uint32)
    assert m.count_batch(TEXTS, code, counts.reshape(-1)) == counts.sum() / 3
    stretch = slow_table(TEXTS, code)
    asked = [*TEXTS, m.tokens(b"quite unheard of: the cat \xf0\x9f\x98\x80")]
    want = [slow_cost(t, code, stretch) for t in asked]
    assert m.score_batch(asked, code, m.stretched(counts)) == pytest.approx(want, rel=2e-3)
    for together in (1, 40):  # texts go forward alike, alone or together, in one piece or in many
        monkeypatch.setattr(m, "TOGETHER", together)
        assert m.score_batch(asked, code, m.stretched(counts)) == pytest.approx(want, rel=2e-3)


def test_probabilities_sum_to_one():
    """Over all codes of one word of one byte, or a common word, as the first token."""
    code = fitted(TEXTS)
    table = np.random.default_rng(0).integers(-60, 60, code.slots).astype(np.int8)
    total = sum(2 ** -m.score_batch([[w]], code, table)[0] for w in code.ids)
    for b in range(256):
        if bytes([b]) not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
            total += 2 ** -m.score_batch([[bytes([b])]], code, table)[0] if bytes([b]) not in code.ids else 0
    assert 0.1 < total <= 1 + 1e-3


def test_events_do_not_depend_on_other_words(monkeypatch):
    code = fitted(TEXTS)
    alone = code.events([b"zebra"])
    monkeypatch.setattr(m, "SPELLED", 2)
    many = code.events([b"mat", b"unknown", b"cat", b"zebra", m.END])
    own = slice(int(many.start[3]), int(many.start[3] + many.size[3]))
    assert all((getattr(alone, n) == getattr(many, n)[own]).all() for n in ("bit", "kind", "so_far", "last"))
    assert alone.word[0] == many.word[3] and alone.end[0] == many.end[3]


@pytest.mark.parametrize("fan", [1, 256])
def test_context_table(spark, monkeypatch, fan):
    monkeypatch.setattr(m, "FAN", fan)
    docs = spark.createDataFrame([(" ".join(w.decode() for w in t[:-1]),) for t in TEXTS] + [(None,)], "t string")
    code = fitted(TEXTS)
    counts = np.zeros((code.slots, 2), np.uint32)
    m.count_batch([*TEXTS, [m.END]], code, counts.reshape(-1))
    assert (m.context_table(docs, "t", code) == m.stretched(counts)).all()


def test_texts_learn_as_they_go(monkeypatch):
    code = fitted(TEXTS)
    table = np.zeros(code.slots, np.int8)
    once, twice = m.score_batch([m.tokens(b"quokka wombat numbat " * n) for n in (20, 40)], code, table)
    assert twice - once < 0.7 * once
    monkeypatch.setattr(m, "RATE", np.float32(0))
    assert abs(m.score_batch([m.tokens(b"quokka wombat numbat " * 40)], code, table)[0] - twice) > 1


def test_tables_follow_the_counted_bits():
    small, large = m.Code([(m.END, 1)], 0, np.zeros(256, np.int64)), m.Code([(m.END, 1)], 10**5, np.full(256, 4000))
    assert small.tables == (16,) * 3 and large.tables == (22,) * 3


@pytest.mark.parametrize("common", [1 << 16, 5])
def test_scores(spark, documents, odd, monkeypatch, common):
    monkeypatch.setattr(m, "COMMON", common)
    for docs in (documents, odd.withColumn("row", odd.doc_id).withColumn("n", odd.doc_id)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = slow_base(rows)
        got = m.score(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == is_held(r.doc_id)
            assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9, abs=1e-9) and r.score < 0
        if docs is documents:
            held = [r for r in got if r.held_out]
            assert np.mean([r.bits_per_byte for r in held]) < 3.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the larger tables")
def test_held_out_texts_beat_the_base(spark):
    got = m.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_table(odd):
    assert m.score(odd.limit(0)).count() == 0


def test_counting_holds_little_beside_the_events():
    """A batch of many different words: what counting holds at a time is a part of their bits."""
    import tracemalloc

    texts = [[b"w%012d" % (i * 7919) for i in range(k, 30_000, 3)] for k in range(3)]
    spelled = np.bincount(np.frombuffer(b"".join(w + b" " for t in texts for w in t), np.uint8), minlength=256)
    code = m.Code([(m.END, 1)], 30_000, spelled)
    bits = int(code.events([w for t in texts for w in t]).size.sum())
    counts = np.zeros(code.slots * 2, np.uint32)
    tracemalloc.start()
    try:
        added = m.count_batch(texts, code, counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # END, which stands before the first word, is known but not counted
    assert added == bits and [int(counts[2 * a : 2 * b].sum()) for a, b in zip(code.offsets, code.offsets[1:])] == [bits] * 3
    assert peak < 36 * bits, peak / bits
