"""Static range asymmetric numeral system over token ids, many lanes at a time.

A block holds the ids of whole documents.  Its ids are dealt to lanes in turn;
lanes share one stream of 32-bit words, in the order in which decoding wants
them.  Checkpoints hold all lanes' states and the place in the stream, so parts
of a block can be decoded apart; a checksum guards each block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LANES, STEPS = 20, 4096, 64
_LOW, _MAGIC = np.uint64(1 << 31), b"TWR1"
_HEAD = struct.Struct("<4sIIQQIIQ")  # magic, checksum of the rest, table's checksum, documents, ids, lanes, checkpoints, words


class Table:
    """Frequencies of all ids that occur, summing to 2^SCALE, and what follows from them."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint32)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.cum[symbols] = np.cumsum(freqs) - freqs
        self.slot = np.repeat(self.symbols, self.freqs)
        self.checksum = zlib.crc32(self.to_bytes())

    @classmethod
    def of_counts(cls, counts: dict[int, int]) -> Table:
        """Shares of the counts, each at least 1 of 2^SCALE; the commonest ids give way."""
        symbols = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
        if not len(symbols):
            return cls(symbols, symbols)
        if len(symbols) > 1 << SCALE:
            raise ValueError(f"more than {1 << SCALE} different ids")
        n = np.array([counts[s] for s in symbols.tolist()], np.float64)
        freqs = np.maximum(1, np.floor(n / n.sum() * (1 << SCALE))).astype(np.int64)
        over = int(freqs.sum()) - (1 << SCALE)
        order = np.argsort(-freqs, kind="stable")
        if over < 0:
            freqs[order[0]] -= over
        for i in order.tolist():
            if over <= 0:
                break
            taken = min(over, int(freqs[i]) // 2)
            freqs[i] -= taken
            over -= taken
        return cls(symbols, freqs)

    def to_bytes(self) -> bytes:
        return np.stack([self.symbols, self.freqs], 1).astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        both = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
        return cls(both[:, 0], both[:, 1])


def encode_block(keys: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """keys: the documents' int64 ids (valid: which aren't null); counts: ids of each document."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        k = len(s)
        f, x = table.freq[s], state[:k]
        # (2^31 >> SCALE) << 32, times the frequency
        full = x >= (f << np.uint64(63 - SCALE))
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:k] = (q << np.uint64(SCALE)) + (x - q * f) + table.cum[s]
        if t % STEPS == 0:
            marks.append(state.copy())
    words.reverse()
    marks.reverse()
    passed = np.concatenate(([0], np.cumsum([len(w) for w in words])))[:-1:STEPS].astype("<u8") if steps else np.zeros(0, "<u8")
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    body = b"".join([keys.astype("<i8").tobytes(), valid.astype("u1").tobytes(), counts.astype("<u8").tobytes(), passed.tobytes(), *[m.astype("<u8").tobytes() for m in marks], stream.astype("<u4").tobytes()])
    head = _HEAD.pack(_MAGIC, 0, table.checksum, len(keys), n, lanes, len(marks), len(stream))
    return head[:4] + struct.pack("<I", zlib.crc32(head[8:] + body)) + head[8:] + body


class Block:
    """A block read back; `ids()` decodes it, `part(i)` decodes from its i-th checkpoint to the next."""

    def __init__(self, data: bytes, table: Table):
        magic, checksum, own, docs, self.n, self.lanes, marks, words = _HEAD.unpack_from(data)
        if magic != _MAGIC or own != table.checksum or zlib.crc32(data[8:]) != checksum:
            raise ValueError("a block of token ids is damaged, or belongs to another table")
        self.table, at = table, _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.valid, self.counts = take("<i8", docs), take("u1", docs).astype(bool), take("<u8", docs).astype(np.int64)
        self.passed, self.marks = take("<u8", marks), take("<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.words = take("<u4", words)

    def part(self, i: int) -> np.ndarray:
        first, last = i * STEPS, min((i + 1) * STEPS, -(-self.n // self.lanes))
        out = np.empty(min(last * self.lanes, self.n) - first * self.lanes, np.uint32)
        state, word, table = self.marks[i].astype(np.uint64), int(self.passed[i]), self.table
        mask, at = np.uint64((1 << SCALE) - 1), 0
        for _ in range(first, last):
            k = min(self.lanes, len(out) - at)
            x = state[:k]
            slot = x & mask
            s = table.slot[slot]
            x = table.freq[s] * (x >> np.uint64(SCALE)) + slot - table.cum[s]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << np.uint64(32)) | self.words[word : word + len(low)]
            word += len(low)
            state[:k] = x
            out[at : at + k] = s
            at += k
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([self.part(i) for i in range(len(self.marks))]) if len(self.marks) else np.zeros(0, np.uint32)
