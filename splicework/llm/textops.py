"""Words of many texts at once, as numpy arrays over their joined UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once.
_BLOCK = 1 << 18


def _table(base: int) -> np.ndarray:
    """base ** 0 .. _BLOCK."""
    out = np.full(_BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _table(_BASE), _table(_INVERSE)


def lut(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = ~lut(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
LETTER_WORDS = lut(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(_BASE) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts and ends ascend. Blocks of the data
    have one running sum of powers each, a longer span is summed up piece by piece."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        k = i + int(np.searchsorted(end[i:], base + _BLOCK, "right"))
        if k == i:
            total, step = 0, 1
            for at in range(base, int(end[i]), _BLOCK):
                piece = data[at : min(at + _BLOCK, int(end[i]))].astype(np.uint64) + np.uint64(1)
                total += step * int((piece * _POWERS[: len(piece)]).sum())
                step = step * pow(_BASE, _BLOCK, 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        piece = data[base : int(end[k - 1])].astype(np.uint64) + np.uint64(1)
        run = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _POWERS[: len(piece)], out=run[1:])
        a = start[i:k] - base
        out[i:k] = (run[end[i:k] - base] - run[a]) * _INVERSES[a]
        i = k
    return mix(out + (end - start).astype(np.uint64))


class Slice:
    """Some texts (null: empty), each followed by one newline byte."""

    def __init__(self, texts: list[bytes | None], lower: bool, word: np.ndarray):
        texts = [t or b"" for t in texts]
        joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        self.data = np.frombuffer(joined.translate(_LOWER), np.uint8) if lower else self.raw
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.is_word = word[self.data]
        edge = np.flatnonzero(np.diff(self.is_word, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        #: Words before each text's first; the last is the number of words.
        self.word_first = np.searchsorted(self.start, self.first)

    def __len__(self) -> int:
        return len(self.sizes)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with at most ``most`` bytes of text, or one text."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if held and held + n > most:
            yield batch.slice(at, i - at), texts[at:i]
            at, held = i, 0
        held += n
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def counts_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])
