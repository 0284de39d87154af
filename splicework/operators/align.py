"""Alignment of transcript pieces: small dynamic programs, run by Spark over batches of
rows, whose tables are filled together. The column functions give a struct column; rows
are independent.

Gapped strings use '-'. N in either string matches all where it says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _costs(a: str, b: str, wild: bool) -> np.ndarray:
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    same = x[:, None] == y[None, :]
    if wild:
        same |= (x[:, None] == 78) | (y[None, :] == 78)
    return (~same).astype(np.int32)


def edit_table(a: str, b: str, wild: bool = False) -> np.ndarray:
    """Unit costs of all prefix pairs; a row at a time, the running insertions by one
    minimum over the row."""
    cost = _costs(a, b, wild) if a and b else np.zeros((len(a), len(b)), np.int32)
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    step = np.arange(len(b) + 1)
    out[0] = step
    for i in range(1, len(a) + 1):
        row = np.empty(len(b) + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(out[i - 1, 1:] + 1, out[i - 1, :-1] + cost[i - 1])
        out[i] = np.minimum.accumulate(row - step) + step
    return out


def edit_rows(a: str, b: str, wild: bool = False) -> tuple[np.ndarray, Callable[[np.ndarray, int], np.ndarray]]:
    """The first row of ``edit_table`` and the step from a row to the next (the i-th)."""
    return _steps(a, b, wild, False)


def _steps(a: str, b: str, wild: bool, score: bool) -> tuple[np.ndarray, Callable[[np.ndarray, int], np.ndarray]]:
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    step = np.arange(len(b) + 1, dtype=np.int32)
    any_of = y == 78
    costs = {c: (y != c).astype(np.int32) if not wild else np.zeros(len(y), np.int32) if c == 78 else ((y != c) & ~any_of).astype(np.int32) for c in set(x.tolist())}
    if score:
        costs = {c: 1 - 2 * v for c, v in costs.items()}

    def following(above: np.ndarray, i: int) -> np.ndarray:
        row = np.empty(len(b) + 1, np.int32)
        if score:
            row[0] = -i
            row[1:] = np.maximum(above[1:] - 1, above[:-1] + costs[x[i - 1]])
            return np.maximum.accumulate(row + step) - step
        row[0] = i
        row[1:] = np.minimum(above[1:] + 1, above[:-1] + costs[x[i - 1]])
        return np.minimum.accumulate(row - step) + step

    return -step if score else step.copy(), following


def each_row(first: np.ndarray, following: Callable[[np.ndarray, int], np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Rows 0 .. n."""
    row = first
    yield row
    for i in range(1, n + 1):
        row = following(row, i)
        yield row


class Rows:
    """Rows 0 .. n of a table that are read downwards: one of each sqrt(n) is kept, and
    those between are made again, so that whole texts fit in memory."""

    def __init__(self, first: np.ndarray, following: Callable[[np.ndarray, int], np.ndarray], n: int):
        self.n, self.following, self.every, self.at = n, following, isqrt(n) + 1, -1
        self.kept, self.block = [], []
        for i, row in enumerate(each_row(first, following, n)):
            if i % self.every == 0:
                self.kept.append(row)
            self.last = row

    def __getitem__(self, i: int) -> np.ndarray:
        k = i // self.every
        if k != self.at:
            self.at, self.block = k, [self.kept[k]]
            for j in range(k * self.every + 1, min((k + 1) * self.every, self.n + 1)):
                self.block.append(self.following(self.block[-1], j))
        return self.block[i - k * self.every]


def global_alignment(est: str, gen: str) -> tuple[str, str, int]:
    """Least edits, N matches all (F19); the diagonal is preferred, then a gap in the
    genome, then one in the transcript."""
    t = Rows(*edit_rows(est, gen, wild=True), len(est))
    i, j, a, b = len(est), len(gen), [], []
    row, above = t.last, t[i - 1] if i else None
    while i or j:
        match = i and j and (est[i - 1] == gen[j - 1] or "N" in (est[i - 1], gen[j - 1]))
        if i and j and row[j] == above[j - 1] + (not match):
            i, j = i - 1, j - 1
            a.append(est[i])
            b.append(gen[j])
        elif i and row[j] == above[j] + 1:
            i -= 1
            a.append(est[i])
            b.append("-")
        else:
            j -= 1
            a.append("-")
            b.append(gen[j])
            continue
        row, above = above, t[i - 1] if i else None
    return "".join(reversed(a)), "".join(reversed(b)), int(t.last[-1])


def gap_alignment(est: str, gen: str) -> tuple[int, int, int, int]:
    """Best alignment with one free gap on the genome (F18): score, cut (bases of the
    transcript before the gap), and the gap's first and last genome position (1-based;
    first > last: no gap). Match 1, mismatch and space -1, N matches all. Of equal cuts
    the leftmost donor with the shortest transcript prefix wins."""
    n = len(est)
    # right[n - i][m - j]: the score of est[i:] with gen[j:]
    right = Rows(*_steps(est[::-1], gen[::-1], True, True), n)
    best = None
    for i, left in enumerate(each_row(*_steps(est, gen, True, True), n)):
        own = right[n - i][::-1]
        # after[j]: the best of aligning est[i:] to a suffix of gen that starts at j or later
        after = np.maximum.accumulate(own[::-1])[::-1]
        total = left + after
        j = int(np.argmax(total))
        if best is None or total[j] > best[0]:
            best = int(total[j]), i, j, j + int(np.argmax(own[j:] == after[j]))
    score, i, j, k = best
    return score, i, j + 1, k if k > j else j


def border_split(p: str, t: str, most: int | None, frequency) -> tuple[int, int, int, int]:
    """Cut p into a prefix and a suffix that align to the two ends of t (F17): edits,
    cut, bases of t used on the left and on the right. Least edits; of equal ones the
    most frequent splice pattern of what lies between. ``most`` edits are looked for, as
    many as p has bases where it is None."""
    reach = min(len(p) + (len(p) if most is None else most), len(t))
    head, tail = each_row(*edit_rows(p, t[:reach]), len(p)), Rows(*edit_rows(p[::-1], t[::-1][:reach]), len(p))
    best = None
    for cut, a in enumerate(head):
        b = tail[len(p) - cut]
        low = int(a.min()) + int(b.min())
        if best and low > -best[0]:
            continue
        for i in np.flatnonzero(a == a.min()):
            for j in np.flatnonzero(b == b.min()):
                if i + j <= len(t):
                    between = t[i : len(t) - j]
                    found = (-low, frequency(between[:2] + between[-2:]) if len(between) >= 4 else 0, -cut, int(i), int(j))
                    if best is None or found[:3] > best[:3]:
                        best = found
    return (-best[0], -best[2], best[3], best[4]) if best else (len(p), 0, 0, 0)


def longest_common_factor(a: str, b: str) -> tuple[int, int, int]:
    """Starts (0-based) and length of the longest common substring, N matching all; the
    first in a's order (F21)."""
    if not a or not b:
        return 0, 0, 0
    y = np.frombuffer(b.encode(), np.uint8)
    same = {c: (y == c) | (y == 78) | (c == 78) for c in set(a.encode())}
    run, best = np.zeros(len(b) + 1, np.int32), (0, 0, 0)
    for i, c in enumerate(a.encode()):
        run[1:] = np.where(same[c], run[:-1] + 1, 0)
        j = int(np.argmax(run))
        if run[j] > best[2]:
            best = i + 1, j, int(run[j])
    return best[0] - best[2], best[1] - best[2], best[2]


def best_affix(e: str, g: str, rate: float = 0.17) -> tuple[int, int]:
    """Lengths of the prefixes of e and g with the least 2 * edits / (lengths), at most
    ``rate``, that end in the same base; later ones win ties (F28)."""
    y, to = np.frombuffer(g.encode(), np.uint8), np.arange(1, len(g) + 1)
    ends = {c: np.flatnonzero(y == ord(c)) for c in set(e)}
    best, at = rate, (0, 0)
    for i, row in enumerate(each_row(*edit_rows(e, g), len(e))):
        if not i or not len(j := ends[e[i - 1]]):
            continue
        r = 2 * row[j + 1] / (i + to[j])
        if (low := r.min()) <= best:
            best, at = low, (i, int(to[j][np.flatnonzero(r == low)[-1]]))
    return at


def best_cut(a: str, b: str) -> tuple[int, int]:
    """The prefix of b that is nearest to a, and its edits; the shortest of equals."""
    for row in each_row(*edit_rows(a, b), len(a)):
        pass
    return int(np.argmin(row)), int(row.min())


def tail_mask(seq: str, window: int = 14, share: float = 0.72) -> tuple[str, int, int]:
    """Poly-A or poly-T ends replaced by * or # (F02), and their lengths (-1: none). A
    seed window must have the share of the letter; it grows while the last window has,
    and then counts up to its last such letter if the whole has the share. A wins ties."""

    def end(s: str) -> tuple[int, str]:
        found = {}
        for letter in "AT":
            hits = np.frombuffer(s.encode(), np.uint8) == ord(letter)
            if len(s) < window or hits[:window].sum() < share * window:
                continue
            last = window
            while last < len(s) and hits[last + 1 - window : last + 1].sum() >= share * window:
                last += 1
            length = int(np.flatnonzero(hits[:last])[-1]) + 1
            if hits[:length].sum() >= share * length:
                found[letter] = length
        if not found:
            return -1, ""
        letter = max(found, key=lambda x: (found[x], x == "A"))
        return found[letter], letter

    (a, x), (b, y) = end(seq), end(seq[::-1])
    a_, b_ = max(a, 0), max(b, 0)
    if a_ + b_ > len(seq):
        b, b_ = -1, 0
    mark = {"A": "*", "T": "#", "": ""}
    return mark[x] * a_ + seq[a_ : len(seq) - b_] + mark[y] * b_, a, b


#: Cells of the tables that a batch of rows holds at once; a pair of texts beyond it is
#: aligned alone, row by row of its table.
CELLS = 1 << 22


def _letters(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, padded to one length, and their lengths."""
    raw = [t.encode("ascii", "replace") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    width = int(size.max(initial=0))
    joined = b"".join(r.ljust(width, bytes([fill])) for r in raw)
    return np.frombuffer(joined, np.uint8).reshape(len(raw), width), size


class Tables:
    """The tables of all prefix pairs of many pairs of texts: edits, or scores (match 1,
    mismatch and space -1), one numpy step for a row of all tables. Cell [r, i, j] is
    meant for i and j within the lengths of pair r."""

    def __init__(self, a: list[str], b: list[str], wild: bool = False, score: bool = False):
        self.x, self.n = _letters(a, 1)
        self.y, self.m = _letters(b, 2)
        (k, w), v = self.x.shape, self.y.shape[1]
        step = np.arange(v + 1, dtype=np.int16)
        self.t = t = np.empty((k, w + 1, v + 1), np.int16)
        t[:, 0] = -step if score else step
        for i in range(1, w + 1):
            c = self.x[:, i - 1, None]
            same = c == self.y
            if wild:
                same |= (c == 78) | (self.y == 78)
            if score:
                t[:, i, 0] = -i
                t[:, i, 1:] = np.maximum(t[:, i - 1, 1:] - 1, t[:, i - 1, :-1] + np.where(same, 1, -1).astype(np.int16))
                t[:, i] = np.maximum.accumulate(t[:, i] + step, axis=1) - step
            else:
                t[:, i, 0] = i
                t[:, i, 1:] = np.minimum(t[:, i - 1, 1:] + 1, t[:, i - 1, :-1] + ~same)
                t[:, i] = np.minimum.accumulate(t[:, i] - step, axis=1) + step

    def row(self, i: np.ndarray) -> np.ndarray:
        """Row i[r] of each table."""
        return self.t[np.arange(len(i)), i]


def global_alignments(a: list[str], b: list[str]) -> list[tuple]:
    """``global_alignment`` of many pairs: all are traced back together."""
    d = Tables(a, b, wild=True)
    k = len(a)
    r, i, j = np.arange(k), d.n.copy(), d.m.copy()
    x, y = (np.pad(v, ((0, 0), (0, 1))) for v in (d.x, d.y))
    most = d.x.shape[1] + d.y.shape[1]
    out = np.zeros((2, k, most), np.uint8)
    for at in range(most - 1, -1, -1):
        open_ = (i > 0) | (j > 0)
        if not open_.any():
            break
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        c, e = x[r, up], y[r, left]
        unequal = ~((c == e) | (c == 78) | (e == 78))
        here = d.t[r, i, j]
        diagonal = (i > 0) & (j > 0) & (here == d.t[r, up, left] + unequal)
        gap = ~diagonal & (i > 0) & (here == d.t[r, up, j] + 1)
        out[0, :, at] = np.where(open_, np.where(diagonal | gap, c, 45), 0)
        out[1, :, at] = np.where(open_, np.where(gap, 45, e), 0)
        i = np.where(open_ & (diagonal | gap), i - 1, i)
        j = np.where(open_ & ~gap, j - 1, j)
    text = lambda v: v.tobytes().lstrip(b"\0").decode()
    return [(text(out[0, q]), text(out[1, q]), int(d.t[q, d.n[q], d.m[q]])) for q in range(k)]


def _turned(rows: list[str]) -> list[str]:
    return [t[::-1] for t in rows]


def gap_alignments(a: list[str], b: list[str]) -> list[tuple]:
    """``gap_alignment`` of many pairs."""
    left, right = Tables(a, b, True, True), Tables(_turned(a), _turned(b), True, True)
    k, v = len(a), left.y.shape[1]
    best = np.full(k, -(1 << 30))
    found = np.zeros((3, k), np.int64)
    r, column = np.arange(k), np.arange(v + 1)
    within = column <= left.m[:, None]
    mirror = np.clip(left.m[:, None] - column, 0, None)
    for i in range(left.x.shape[1] + 1):
        live = i <= left.n
        own = np.where(within, right.row(np.clip(left.n - i, 0, None))[r[:, None], mirror], -(1 << 14))
        after = np.maximum.accumulate(own[:, ::-1], axis=1)[:, ::-1]
        total = np.where(within, left.t[:, i] + after, -(1 << 14))
        j = np.argmax(total, axis=1)
        # the first place from j on where what follows is best
        to = np.argmax((own == after[r, j][:, None]) & (column >= j[:, None]), axis=1)
        new = live & (total[r, j] > best)
        best = np.where(new, total[r, j], best)
        found = np.where(new, np.stack([np.full(k, i), j, to]), found)
    return [(int(best[q]), int(found[0, q]), int(found[1, q]) + 1, int(max(found[1, q], found[2, q]))) for q in range(k)]


def border_splits(a: list[str], b: list[str], most: int | None, frequency: Callable[[str], int]) -> list[tuple]:
    """``border_split`` of many pairs: only cuts with the least edits are looked at."""
    reach = [min(len(p) + (len(p) if most is None else most), len(t)) for p, t in zip(a, b, strict=True)]
    head, tail = Tables(a, [t[:n] for t, n in zip(b, reach, strict=True)]), Tables(_turned(a), [t[::-1][:n] for t, n in zip(b, reach, strict=True)])
    outside = np.arange(head.t.shape[2]) > head.m[:, None]
    inside = [np.where(outside[:, None, :], 1 << 14, x.t) for x in (head, tail)]
    low, first = [x.min(axis=2).astype(np.int64) for x in inside], [x.argmin(axis=2) for x in inside]
    # the number of each two letters of t, and the frequency of donor and acceptor by number
    code = np.full(256, 4)
    code[[ord(x) for x in "ACGTacgt"]] = [0, 1, 2, 3] * 2
    letter = code[np.pad(_letters(b, 0)[0], ((0, 0), (0, 2)))]
    pair = 5 * letter[:, :-1] + letter[:, 1:]
    two = [x + y for x in "ACGTN" for y in "ACGTN"]
    by_pair = np.array([[frequency(x + y) for y in two] for x in two])
    out = []
    for q, (p, t) in enumerate(zip(a, b, strict=True)):
        n = len(p)
        total = np.where(first[0][q, : n + 1] + first[1][q, n::-1] <= len(t), low[0][q, : n + 1] + low[1][q, n::-1], 1 << 15)
        best = (-1, 0, 0, 0)
        least = int(total.min())
        cuts = np.flatnonzero(total == least) if least < 1 << 15 else ()
        for cut in cuts[:1] if len(t) < 4 else cuts:  # too short for a pattern: the first
            i = np.flatnonzero(head.t[q, cut, : reach[q] + 1] == low[0][q, cut])[:, None]
            j = np.flatnonzero(tail.t[q, n - cut, : reach[q] + 1] == low[1][q, n - cut])[None, :]
            between = len(t) - i - j
            fits = np.where(between >= 0, np.where(between >= 4, by_pair[pair[q, i], pair[q, np.maximum(len(t) - j - 2, 0)]], 0), -1)
            at = np.unravel_index(int(np.argmax(fits)), fits.shape)
            if (fits[at], -cut) > best[:2]:
                best = (int(fits[at]), -int(cut), int(i[at[0], 0]), int(j[0, at[1]]))
        out.append((least, -best[1], best[2], best[3]) if best[0] >= 0 else (n, 0, 0, 0))
    return out


def common_factors(a: list[str], b: list[str]) -> list[tuple]:
    """``longest_common_factor`` of many pairs."""
    x, n = _letters(a, 1)
    y, _ = _letters(b, 2)
    k = len(a)
    r, run = np.arange(k), np.zeros((k, y.shape[1] + 1), np.int32)
    best = np.zeros((3, k), np.int64)
    for i in range(x.shape[1]):
        c = x[:, i, None]
        same = ((c == y) | (c == 78) | (y == 78)) & (c != 1) & (y != 2)
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        j = np.argmax(run, axis=1)
        best = np.where(run[r, j] > best[2], np.stack([np.full(k, i + 1), j, run[r, j]]), best)
    return [(int(best[0, q] - best[2, q]), int(best[1, q] - best[2, q]), int(best[2, q])) for q in range(k)]


def best_affixes(a: list[str], b: list[str], rate: float = 0.17) -> list[tuple]:
    """``best_affix`` of many pairs."""
    d = Tables(a, b)
    k, v = len(a), d.y.shape[1]
    if not v:
        return [(0, 0)] * k
    r, to = np.arange(k), np.arange(1, v + 1)
    best, at = np.full(k, rate), np.zeros((2, k), np.int64)
    for i in range(1, d.x.shape[1] + 1):
        ratio = np.where(d.x[:, i - 1, None] == d.y, 2 * d.t[:, i, 1:] / (i + to), np.inf)
        j = v - 1 - np.argmin(ratio[:, ::-1], axis=1)
        new = ratio[r, j] <= best
        best = np.where(new, ratio[r, j], best)
        at = np.where(new, np.stack([np.full(k, i), j + 1]), at)
    return [(int(at[0, q]), int(at[1, q])) for q in range(k)]


def best_cuts(a: list[str], b: list[str]) -> list[tuple]:
    """``best_cut`` of many pairs."""
    d = Tables(a, b)
    last = np.where(np.arange(d.t.shape[2]) > d.m[:, None], 1 << 14, d.row(d.n))
    at = np.argmin(last, axis=1)
    return [(int(at[q]), int(last[q, at[q]])) for q in range(len(a))]


def _parts(a: list[str], b: list[str]) -> Iterator[list[int]]:
    """Rows whose tables together have at most CELLS cells; of similar size, as all are
    padded to the largest."""
    part, w, v = [], 0, 0
    for q in sorted(range(len(a)), key=lambda q: (len(a[q]), len(b[q]))):
        w2, v2 = max(w, len(a[q]) + 1), max(v, len(b[q]) + 1)
        if part and w2 * v2 * (len(part) + 1) > CELLS:
            yield part
            part, w2, v2 = [], len(a[q]) + 1, len(b[q]) + 1
        part.append(q)
        w, v = w2, v2
    if part:
        yield part


def _pairs_udf(many: Callable, alone: Callable, schema: str, a: Column, b: Column, *more: Column, finish: Callable | None = None) -> Column:
    """A struct column: ``many`` over parts of each batch of pairs, ``alone`` for a pair
    that is too large for a part. ``finish`` sees (result, a, b, more ...) of a row. A
    null text is the empty text."""
    names = [c.split()[0] for c in schema.split(", ")]

    @pandas_udf(schema)
    def run(*series: pd.Series) -> pd.DataFrame:
        x, y = (["" if t is None else t for t in s] for s in series[:2])
        out: list = [None] * len(x)
        for part in _parts(x, y):
            p, q = [x[i] for i in part], [y[i] for i in part]
            large = (len(p[-1]) + 1) * (len(q[-1]) + 1) > CELLS
            for i, found in zip(part, [alone(p[0], q[0])] if large else many(p, q), strict=True):
                out[i] = found if finish is None else finish(found, x[i], y[i], *(s.iloc[i] for s in series[2:]))
        return pd.DataFrame(out, columns=names)

    return run(a, b, *more)


def _frequency() -> Callable[[str], int]:
    from ..functions.sequence import FREQUENCIES

    known = dict(FREQUENCIES)
    return lambda k: known.get(k.upper(), 0)


def aligned(est: Column, gen: Column) -> Column:
    """struct<est, gen, edits>."""
    return _pairs_udf(global_alignments, global_alignment, "est string, gen string, edits int", est, gen)


def spliced(est: Column, gen: Column) -> Column:
    """struct<score, cut, intron_start, intron_end>."""
    return _pairs_udf(gap_alignments, gap_alignment, "score int, cut int, intron_start int, intron_end int", est, gen)


def split_border(p: Column, t: Column, most: int | None) -> Column:
    """struct<edits, cut, left, right>."""
    known = _frequency()
    return _pairs_udf(lambda a, b: border_splits(a, b, most, known), lambda a, b: border_split(a, b, most, known), "edits int, cut int, left int, right int", p, t)


def common_factor(a: Column, b: Column) -> Column:
    """struct<a_start, b_start, length>."""
    return _pairs_udf(common_factors, longest_common_factor, "a_start int, b_start int, length int", a, b)


def masked(seq: Column) -> Column:
    """struct<seq, prefix, suffix>."""

    @pandas_udf("seq string, prefix int, suffix int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tail_mask("" if t is None else t) for t in texts], columns=["seq", "prefix", "suffix"])

    return run(seq)


def affix(e: Column, g: Column) -> Column:
    """struct<est_length, gen_length>."""
    return _pairs_udf(best_affixes, best_affix, "est_length int, gen_length int", e, g)


def cut(a: Column, b: Column) -> Column:
    """struct<cut, edits>."""
    return _pairs_udf(best_cuts, best_cut, "cut int, edits int", a, b)


def refined_junction(est: Column, gen: Column, expected: Column | None = None, least: int = 40, shift: int = 20) -> Column:
    """A splice junction realigned (P12): the gap alignment's, moved along identical
    bases to the most frequent pattern; null where the intron is shorter than
    ``least`` or a site moved by more than ``shift`` from the ``expected`` cut (30)."""
    known = _frequency()

    def slide(found: tuple, e: str, g: str, middle: int) -> tuple:
        score, at, start, end = found
        if end - start + 1 < least or abs(at - middle) > shift:
            return None, None, None, None
        best = (known(g[start - 1 : start + 1] + g[end - 2 : end]), 0)
        for way in (-1, 1):
            k = 0
            while True:
                a, b = (start - 1 + k - 1, end + k - 1) if way < 0 else (start - 1 + k, end + k)
                if min(a, b) < 0 or max(a, b) >= len(g) or g[a] != g[b]:
                    break
                k += way
                best = max(best, (known(g[start - 1 + k : start + 1 + k] + g[end - 2 + k : end + k]), k), key=lambda x: (x[0], -abs(x[1])))
        return score, at + best[1], start + best[1], end + best[1]

    return _pairs_udf(gap_alignments, gap_alignment, "score int, cut int, intron_start int, intron_end int", est, gen, F.lit(30) if expected is None else expected, finish=slide)


def noisy(est: Column, gen: Column) -> Column:
    """Whether an exon has more edits than its length allows."""
    from ..functions.sequence import allowed_errors

    return F.call_function("levenshtein", est, gen, allowed_errors(F.length(est))) < 0  # banded: beyond the limit it gives -1


def external_exon_fails(length: Column, edits: Column, pattern: Column) -> Column:
    """Outer exons of under 10 bases, or under 20 without GT-AG or GC-AG and no edits,
    are dropped (P06)."""
    return (length < 10) | ((length < 20) & ~(pattern.isin("GTAG", "GCAG") & (edits == 0)))
