"""Ratcliff-Obershelp ratios of many pairs of texts at once, for tasks that compare spellings.

``difflib`` takes tens of microseconds a pair.  Here a text of at most 64
characters is a row of bit masks, and all pairs take each step together: the
longest common block (earliest in the first text, then in the second), then what
lies left and right of it, until nothing matches.  Results equal ``difflib``'s to
the last bit.  Longer texts, where ``difflib`` also leaves out popular characters,
go through ``difflib`` itself.

The module travels with the job (it is pickled by value): standard library, numpy
and pyarrow only.
"""

from __future__ import annotations

import sys
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = 64  # characters that fit a mask
PAIRS = 4096  # pairs that take a step together
ALPHABET = 1024  # distinct characters up to which masks are kept by character
ROWS = 256  # rows of a tile that are filtered together
MARKS = 128  # buckets of characters by which tiles are told apart; ASCII has one each
ANY = 64  # distinct characters of a place up to which they are told apart
STEPS = 100_000  # pairs of places that are looked at for a bound; beyond, the bound is weaker
KNOWN = 500_000  # components whose links a task remembers
DIGITS = 6  # digits up to which forms that differ in digits only are counted by digits
CELLS = 1 << 18  # patterns of numbers that are looked up together
SPELLED = 1 << 14  # patterns of numbers that are compared together
FEW_TEXTS = 1 << 16  # forms up to which pairs may be compared instead
LONG = 200  # from here on difflib leaves out popular characters
FAR = (8, 3, 5, 7, 1, 2, 4, 6)  # sixteenths of the sorted texts that far pairs are apart
ONE = np.uint64(1)


class Texts:
    """Texts of a task: lengths, characters, and a sketch of the characters of each."""

    def __init__(self, values: list[str]):
        self.values = values
        self.length = np.array([len(v) for v in values], dtype=np.int64)
        points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        row = np.repeat(np.arange(len(values)), self.length)
        column = np.arange(len(points)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        found, code = np.unique(points, return_inverse=True)
        self.alphabet = len(found)
        short = column < WORD
        self.code = np.full((len(values), min(WORD, int(self.length.max(initial=1)))), self.alphabet, dtype=np.int32)
        self.code[row[short], column[short]] = code[short]
        self._points = row, points
        self._made: np.ndarray | None = None
        self._masks: dict = {}
        self._ends: tuple | None = None

    @property
    def sketch(self) -> np.ndarray:
        """Two words of bits, one bit flipped for each character and its how-many-eth occurrence.

        Two texts differ in at most as many bits as characters must be added and removed.
        """
        if self._made is None:
            self._made = self._sketch(*self._points)
        return self._made

    def _sketch(self, row: np.ndarray, points: np.ndarray) -> np.ndarray:
        order = np.lexsort((points, row))
        r, c = row[order].astype(np.uint64), points[order].astype(np.uint64)
        new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])) if len(r) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        nth = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
        x = (c * np.uint64(0x9E3779B97F4A7C15)) ^ (nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bit = x >> np.uint64(57)
        out = np.zeros((len(self.values), 2), dtype=np.uint64)
        np.bitwise_xor.at(out, (row[order], (bit >> np.uint64(6)).astype(np.int64)), ONE << (bit & np.uint64(63)))
        return out

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each character of ``a`` and pair: the places in ``b`` with that character, as bits."""
        width = max(int(self.length[a].max(initial=1)), int(self.length[b].max(initial=1)))
        kind = np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
        first = self.code[a, :width].T
        if self.alphabet <= ALPHABET:
            if kind not in self._masks:
                masks = np.zeros((len(self.values), self.alphabet + 1), dtype=np.uint64)
                for j in range(self.code.shape[1]):
                    masks[np.arange(len(self.values)), self.code[:, j]] |= ONE << np.uint64(j)
                masks[:, self.alphabet] = 0
                self._masks[kind] = masks.astype(kind).ravel()
            return self._masks[kind].take(first + b * (self.alphabet + 1))
        second = self.code[b]
        out = np.zeros(first.shape, dtype=kind)
        for j in range(min(width, second.shape[1])):
            out |= ((first == second[:, j]) & (first < self.alphabet)).astype(kind) << kind(j)
        return out

    @property
    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that fit a mask: characters from the end, and places from both ends whose character comes once, as bits."""
        if self._ends is None:
            n, width = self.code.shape
            length = np.minimum(self.length, width)[:, None]
            at = np.arange(width)
            inside = at < length
            back = np.where(inside, np.take_along_axis(self.code, np.maximum(length - 1 - at, 0), axis=1), self.alphabet)
            key = np.arange(n)[:, None] * (self.alphabet + 1)
            often = np.bincount((key + self.code).ravel(), minlength=n * (self.alphabet + 1))
            bit = ONE << at.astype(np.uint64)
            once = [(((often[key + code] == 1) & inside) * bit).sum(axis=1, dtype=np.uint64) for code in (self.code, back)]
            self._ends = back, *once
        return self._ends

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common beginning and of the common end that surely are the first common block, else 0.

        A block as long as a common beginning that is longer than half of both texts
        covers what lies between its length and what it leaves of the longer text.  If
        a character there comes once in each text, the block is on the same diagonal,
        so it is this beginning.  An end is the same from behind.
        """
        none = np.zeros(len(a), dtype=np.int64)
        if self.alphabet > ALPHABET:
            return none, none
        longer = np.maximum(self.length[a], self.length[b])
        shorter = np.minimum(self.length[a], self.length[b])
        below = np.array([(1 << k) - 1 for k in range(WORD + 1)], dtype=np.uint64)
        found = []
        back, *once = self.ends
        width = int(longer.max(initial=1))
        for code, single in zip((self.code, back), once, strict=True):
            differ = code[a, :width] != code[b, :width]
            size = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), shorter)
            rest = np.minimum(longer - size, size)
            sure = (single[a] & single[b] & below[size] & ~below[rest]) != 0
            found.append(np.where(sure, size, 0))
        start, end = found
        return start, np.where(start > 0, 0, end)

    def matched(self, a: np.ndarray, b: np.ndarray, enough: np.ndarray | None = None) -> np.ndarray:
        """Characters in common blocks, of pairs of texts that fit a mask.

        A pair that has ``enough`` of them is not followed further: its number is a lower bound.
        """
        places = self.places(a, b)
        kind = places.dtype.type
        bits = kind().itemsize * 8
        below = np.array([(1 << min(k, bits)) - 1 for k in range(bits + 1)], dtype=np.uint64).astype(kind)
        start, end = self.anchors(a, b)
        total = start + end
        a1, b1 = self.length[a] - end, self.length[b] - end
        left = (start < a1) & (start < b1)
        if enough is not None:
            left &= total < enough
        pair = np.flatnonzero(left)
        a0, b0, a1, b1 = start[pair], start[pair], a1[pair], b1[pair]
        line = np.arange(places.shape[0])[:, None]
        own = places[:, pair] & (below[b1] & ~below[b0])
        own *= (line >= a0) & (line < a1)
        while len(pair):
            size, at, where = _longest(own)
            hit = size > 0
            pair, a0, a1, b0, b1, size, at, where = (x[hit] for x in (pair, a0, a1, b0, b1, size, at, where))
            total += np.bincount(pair, weights=size, minlength=len(total)).astype(np.int64)
            pair = np.concatenate([pair, pair])
            a0, a1 = np.concatenate([a0, at + size]), np.concatenate([at, a1])
            b0, b1 = np.concatenate([b0, where + size]), np.concatenate([where, b1])
            left = (a0 < a1) & (b0 < b1)
            if enough is not None:
                left &= total[pair] < enough[pair]
            pair, a0, a1, b0, b1 = (x[left] for x in (pair, a0, a1, b0, b1))
            own = places[:, pair] & (below[b1] & ~below[b0])
            own *= (line >= a0) & (line < a1)
        return total

    def reaches(self, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the longest common subsequence of each pair allows the ratio: blocks in common are one, if not the longest.

        Pairs that do not fit a mask are not looked at.
        """
        out = np.ones(len(a), dtype=bool)
        at = np.flatnonzero(np.maximum(self.length[a], self.length[b]) <= WORD)
        for s in range(0, len(at), PAIRS):
            own = at[s : s + PAIRS]
            places = self.places(a[own], b[own])
            free = np.full(len(own), ~places.dtype.type(0))  # places of the second text that are not in it
            for line in places:
                taken = free & line
                free = (free + taken) | (free - taken)
            out[own] = 2 * np.bitwise_count(~free).astype(np.int64) >= threshold * (self.length[a[own]] + self.length[b[own]]) - 1e-9
        return out

    def ratios(self, a: np.ndarray, b: np.ndarray, known: float | None = None) -> np.ndarray:
        """Ratio of each pair; ``a`` is the first text.  From ``known`` on, any value from it on may stand for it."""
        out = np.empty(len(a))
        whole = self.length[a] + self.length[b]
        short = np.maximum(self.length[a], self.length[b]) <= WORD
        at = np.flatnonzero(short)
        for s in range(0, len(at), PAIRS):
            own = at[s : s + PAIRS]
            enough = None if known is None else np.ceil(known * whole[own] / 2 - 1e-9)
            out[own] = 2.0 * self.matched(a[own], b[own], enough) / np.maximum(whole[own], 1)
        out[whole == 0] = 1.0
        rest = np.flatnonzero(~short)
        matcher = SequenceMatcher(None)
        for i in rest[np.argsort(b[rest], kind="stable")].tolist():
            matcher.set_seqs(self.values[a[i]], self.values[b[i]])
            out[i] = matcher.ratio()
        return out


def _longest(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and beginnings of the longest diagonal run of bits in each column of masks."""
    n, one = own.shape[1], own.dtype.type(1)
    size, at, where = (np.zeros(n, dtype=np.int64) for _ in range(3))
    on = np.bitwise_or.reduce(own, axis=0) != 0
    alive = np.flatnonzero(on)
    if len(alive) < n:
        own = own[:, alive]
    run, k = own, 0
    while len(alive):
        k += 1
        more = np.empty_like(run)
        more[0] = 0
        np.left_shift(run[:-1], one, out=more[1:])
        more[1:] &= own[1:]
        on = np.bitwise_or.reduce(more, axis=0) != 0
        if not on.all():
            done = np.flatnonzero(~on)
            ends = run[:, done]
            column = (ends != 0).argmax(axis=0)
            mask = ends[column, np.arange(len(done))]
            lowest = np.bitwise_count((mask & (~mask + one)) - one).astype(np.int64)
            size[alive[done]], at[alive[done]], where[alive[done]] = k, column - k + 1, lowest - k + 1
            keep = np.flatnonzero(on)
            alive, own, more = alive[keep], own[:, keep], more[:, keep]
        run = more
    return size, at, where


def candidates(texts: Texts, rows: np.ndarray, columns: np.ndarray, label: np.ndarray, threshold: float,
               length_ratio: float):
    """Pairs (row, column) that may be similar and have different labels, in parts.

    A ratio of t allows (1 - t) times the joint length of additions and removals,
    which is at least the number of bits in which sketches differ.  If rows and
    columns are the same texts, a pair comes once.
    """
    same = np.array_equal(rows, columns)
    for s in range(0, len(rows), ROWS):
        own, other = rows[s : s + ROWS], columns[s if same else 0 :]
        fits = label[own][:, None] != label[other]
        if same:
            fits[:, : len(own)] &= np.tri(len(own), dtype=bool).T
        if not fits.any():
            continue
        lengths, at = np.unique(texts.length[own], return_inverse=True)
        length, other_length = lengths[:, None], texts.length[other]
        allowed = np.minimum(np.floor((1 - threshold) * (length + other_length) + 1e-9), 254) + 1
        allowed[np.minimum(length, other_length) < length_ratio * np.maximum(length, other_length) - 1e-9] = 0
        apart = np.bitwise_count(texts.sketch[own][:, 0, None] ^ texts.sketch[other][:, 0])
        apart += np.bitwise_count(texts.sketch[own][:, 1, None] ^ texts.sketch[other][:, 1])  # 128 bits fit a byte
        fits &= apart < np.maximum(allowed, 0).astype(np.uint8)[at]
        i, j = np.nonzero(fits)
        for k in range(0, len(i), PAIRS):
            yield own[i[k : k + PAIRS]], other[j[k : k + PAIRS]]


def reaching(texts: Texts, pairs, threshold: float):
    """Pairs of ``candidates`` whose longest common subsequence allows the ratio, in larger parts."""
    held, n = [], 0
    for a, b in pairs:
        keep = texts.reaches(a, b, threshold)
        held.append((a[keep], b[keep]))
        n += len(held[-1][0])
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def similar(texts: Texts, a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, length_ratio: float) -> np.ndarray:
    """Ratio of each pair, the text with the lower ``turn`` first; 0 below the threshold or the ratio of lengths."""
    swap = turn[a] > turn[b]
    first, second = np.where(swap, b, a), np.where(swap, a, b)
    length = texts.length
    gate = np.minimum(length[a], length[b]) / np.maximum(np.maximum(length[a], length[b]), 1) >= length_ratio
    out = np.zeros(len(a))
    out[gate] = texts.ratios(first[gate], second[gate])
    out[out < threshold] = 0
    return out


def forest(texts: Texts, rows: np.ndarray, columns: np.ndarray, label: np.ndarray, turn: np.ndarray,
           threshold: float, length_ratio: float) -> list[tuple[int, int]]:
    """Pairs that join all texts with a similar one; texts of one label are joined already."""
    label = label.copy()
    found = []
    for a, b in candidates(texts, rows, columns, label, threshold, length_ratio):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        hit = similar(texts, a, b, turn, threshold, length_ratio) > 0
        for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                found.append((x, y))
    return found


def _shared(values: list[str], ahead: bool) -> int:
    """Length of the beginning (or end) that all values have."""
    turned = values if ahead else [v[::-1] for v in values]
    low, high = min(turned), max(turned)
    return next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))


def least_matched(values: list[str]) -> int:
    """Characters that any two of the values have in common blocks at least.

    The shared beginning and end each are a common block.  Both count if the
    longer one is longer than all else of a value, and the character where it
    begins (or ends) comes once in every value: then every block of that length
    holds this character, so that it lies on the same diagonal and leaves the other.
    """
    start, end = _shared(values, True), _shared(values, False)
    shortest, longest = min(map(len, values)), max(map(len, values))
    if start + end > shortest or not start or not end:
        return max(start, end)
    if end >= start:
        mark, rest = values[0][-end], longest - end
    else:
        mark, rest = values[0][start - 1], longest - start
    if max(start, end) > rest and all(v.count(mark) == 1 for v in values):
        return start + end
    return max(start, end)


def _bound(texts: Texts, a: np.ndarray, b: np.ndarray) -> float:
    """No ratio between texts of ``a`` and ``b`` is lower; all of ``a``, and all of ``b``, have one length."""
    values = [texts.values[i] for i in np.union1d(a, b).tolist()]
    whole = int(texts.length[a[0]] + texts.length[b[0]])
    return 2.0 * least_matched(values) / whole if whole and max(map(len, values)) < LONG else 0.0


def least_common(first: list, second: list) -> int:
    """Characters that two texts have in common blocks at least, from the characters that may stand at each place.

    ``first`` and ``second`` give a set a place, or None for any.  Places of one
    same character in both are sure.  The longest common block is at least as long
    as the longest sure run, and cannot be longer by a sure place beside it; each
    such block is tried, with what is sure left and right of it.
    """
    n, m = len(first), len(second)
    sure = [[0] * (m + 1) for _ in range(n + 1)]
    may = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            x, y = first[i], second[j]
            if x is None or y is None or not x.isdisjoint(y):
                may[i][j] = may[i + 1][j + 1] + 1
                if x is not None and len(x) == 1 and x == y:
                    sure[i][j] = sure[i + 1][j + 1] + 1
    seen: dict = {}
    steps = 0

    def least(s: int, e: int, t: int, f: int) -> int:
        nonlocal steps
        if s >= e or t >= f:
            return 0
        key = s, e, t, f
        if key in seen:
            return seen[key]
        steps += (e - s) * (f - t)
        known = max(min(sure[i][j], e - i, f - j) for i in range(s, e) for j in range(t, f))
        best = known
        if known and steps < STEPS:
            best = min(e - s, f - t)
            for i in range(s, e - known + 1):
                for j in range(t, f - known + 1):
                    run = min(may[i][j], e - i, f - j)
                    if run < known or (i > s and j > t and sure[i - 1][j - 1]):
                        continue
                    for size in range(known, min(run, best - 1) + 1):
                        if i + size < e and j + size < f and sure[i + size][j + size]:
                            continue
                        best = min(best, size + least(s, i, t, j) + least(i + size, e, j + size, f))
        seen[key] = best
        return best

    return least(0, n, 0, m)


def lowest(texts: Texts, rows: np.ndarray, columns: np.ndarray, turn: np.ndarray, known: float, floor: np.ndarray,
           all_pairs: bool = True) -> tuple[float, int]:
    """Lowest ratio between a row and a column, if below ``known``; and how many pairs were compared.

    No ratio of a text is below its ``floor``.  Texts meet by their lengths, in the
    order of the bounds of the lengths; the search ends when no lower ratio is
    possible.  Without ``all_pairs`` only far pairs of the sorted texts are compared.
    """

    def compare(a, b):
        nonlocal known, compared
        swap = turn[a] > turn[b]
        compared += len(a)
        if len(a):
            known = min(known, float(texts.ratios(np.where(swap, b, a), np.where(swap, a, b), known).min()))

    compared = 0
    if not all_pairs:
        least = float(floor.min())
        for k in FAR if least > 0 else FAR[:2]:
            if known <= least:
                break
            far = columns[(np.arange(len(rows)) + len(columns) * k // 16) % len(columns)]
            compare(rows[rows != far], far[rows != far])
        return known, compared
    same = np.array_equal(rows, columns)
    by_row = {n: rows[texts.length[rows] == n] for n in np.unique(texts.length[rows]).tolist()}
    by_column = {n: columns[texts.length[columns] == n] for n in np.unique(texts.length[columns]).tolist()}
    meets = sorted((max(_bound(texts, a, b), float(floor[a[0]]), float(floor[b[0]])), n, m)
                   for n, a in by_row.items() for m, b in by_column.items() if not same or n <= m)
    for bound, n, m in meets:
        if bound >= known:
            break
        a, b = by_row[n], by_column[m]
        step = max(1, 4 * PAIRS // len(b))
        for s in range(0, len(a), step):
            i, j = np.meshgrid(np.arange(s, min(s + step, len(a))), np.arange(len(b)), indexing="ij")
            pick = i < j if same and n == m else np.ones(i.shape, dtype=bool)
            compare(a[i[pick]], b[j[pick]])
            if bound >= known:
                break
    return known, compared


# --- what the tasks run ------------------------------------------------------

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _turns(table: pa.Table) -> np.ndarray:
    order = np.lexsort((table["first"].to_numpy(), table["rank"].to_numpy()))
    turn = np.empty(len(order), dtype=np.int64)
    turn[order] = np.arange(len(order))
    return turn


def _links(fid: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    return pa.table([fid[a], fid[b]], schema=LINKS)


def joined(batches):
    """Components (id, smallest id reachable) of all edges (a, b) of a task."""
    tree: dict[int, int] = {}
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            _join(tree, x, y)
    ids = list(tree)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "component": pa.array([_root(tree, x) for x in ids], pa.int64())})


def _root(tree: dict[int, int], x: int) -> int:
    top = tree.setdefault(x, x)
    while top != x:
        tree[x] = tree[top]
        x, top = top, tree[top]
    return x


def _join(tree: dict[int, int], x: int, y: int) -> bool:
    """Tie two ids under the smaller of their roots; whether they were apart."""
    low, high = sorted((_root(tree, x), _root(tree, y)))
    tree[high] = low
    return low != high


def _after_held(batches):
    """Batches of rows with the last row of the batch before in front: (table, whether it has one)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if len(table):
            whole = table if held is None else pa.concat_tables([held, table])
            yield whole, held is not None
            held = table.slice(len(table) - 1)


def _alike_next(table: pa.Table, threshold: float, length_ratio: float, open_: np.ndarray | None = None) -> np.ndarray:
    """Rows that are similar to the row after them in the same ``part``, of those that are ``open_``."""
    part = table["part"].to_numpy(zero_copy_only=False)
    same = part[1:] == part[:-1]
    at = np.flatnonzero(same if open_ is None else same & open_)
    if not len(at):
        return at
    asked = np.union1d(at, at + 1)
    own = table.take(asked)
    a, b = np.searchsorted(asked, at), np.searchsorted(asked, at + 1)
    return at[similar(Texts(own["norm"].to_pylist()), a, b, _turns(own), threshold, length_ratio) > 0]


def runs(batches, threshold: float, length_ratio: float):
    """Sorted rows (part, norm, fid, rank, first) with ``comp``, the first form of the run of similar neighbours."""
    head = 0
    for table, held in _after_held(batches):
        fid = table["fid"].to_numpy()
        tied = np.zeros(len(fid), dtype=bool)
        tied[_alike_next(table, threshold, length_ratio) + 1] = True
        start = np.maximum.accumulate(np.where(tied, 0, np.arange(len(fid))))
        begin = fid[start]
        if held:  # the first row was the last of the batch before
            begin[start == 0] = head
        head = int(begin[-1])
        yield from table.append_column("comp", pa.array(begin)).slice(int(held)).to_batches()


def neighbours(batches, threshold: float, length_ratio: float):
    """Links between components of consecutive forms of sorted rows (part, norm, comp, rank, first).

    Components that earlier links of the task join already are not compared.
    """
    tree: dict[int, int] = {}
    for table, _ in _after_held(batches):
        comp = table["comp"].to_numpy()
        names, place = np.unique(comp, return_inverse=True)
        root = np.array([_root(tree, x) if x in tree else x for x in names.tolist()], dtype=np.int64)[place]
        at = _alike_next(table, threshold, length_ratio, root[1:] != root[:-1])
        pairs = np.unique(np.stack([comp[at], comp[at + 1]]), axis=1)
        if len(tree) > KNOWN:
            tree = {}
        new = [_join(tree, x, y) for x, y in pairs.T.tolist()]
        yield from pa.table([pairs[0][new], pairs[1][new]], schema=LINKS).to_batches()


TILES = pa.schema([("part", pa.string()), ("class", pa.int32()), ("owner", pa.int64()), ("tile", pa.int32()),
                   ("low", pa.int64()), ("high", pa.int64()), ("short", pa.int32()), ("long", pa.int32()),
                   ("least", pa.list_(pa.int32())), ("most", pa.list_(pa.int32()))])


def tiled(table: pa.Table) -> pa.Table:
    """What a tile of rows (part, class, owner, tile, norm, comp) has in common: components, lengths, characters.

    Characters are counted by ``MARKS`` buckets; each has its least and its most occurrences in a text.
    """
    values, comp = table["norm"].to_pylist(), table["comp"].to_numpy()
    length = np.array([len(v) for v in values], dtype=np.int64)
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(values)), length)
    counts = np.bincount(row * MARKS + points % MARKS, minlength=len(values) * MARKS).reshape(-1, MARKS)
    own = [table[c][0].as_py() for c in ("part", "class", "owner", "tile")]
    own += [int(x) for x in (comp.min(), comp.max(), length.min(), length.max())]
    own += [counts.min(axis=0).tolist(), counts.max(axis=0).tolist()]
    return pa.table([[x] for x in own], schema=TILES)


def linked(table: pa.Table, threshold: float, length_ratio: float) -> pa.Table:
    """Forest of components (comp) between two tiles of rows (side, norm, rank, first, comp); side 2: a tile with itself."""
    side = table["side"].to_numpy()
    texts = Texts(table["norm"].to_pylist())
    everywhere = np.arange(len(side))
    rows, columns = (everywhere, everywhere) if (side == 2).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    label = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
    found = forest(texts, rows, columns, label, _turns(table), threshold, length_ratio)
    return _links(table["comp"].to_numpy(), found)


COUNTED = pa.schema([("fid", pa.int64()), ("links", pa.int64()), ("best", pa.float64())])


def counted(table: pa.Table, threshold: float, length_ratio: float) -> pa.Table:
    """How many forms of the other tile each is similar to, and the highest ratio."""
    side = table["side"].to_numpy()
    texts, turn = Texts(table["norm"].to_pylist()), _turns(table)
    n = len(side)
    everywhere, label = np.arange(n), np.arange(n)
    rows, columns = (everywhere, everywhere) if (side == 2).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, best = np.zeros(n, dtype=np.int64), np.zeros(n)
    for a, b in reaching(texts, candidates(texts, rows, columns, label, threshold, length_ratio), threshold):
        ratio = similar(texts, a, b, turn, threshold, length_ratio)
        for x in (a[ratio > 0], b[ratio > 0]):
            np.add.at(links, x, 1)
            np.maximum.at(best, x, ratio[ratio > 0])
    some = links > 0
    return pa.table([table["fid"].to_numpy()[some], links[some], best[some]], schema=COUNTED)


SHAPES_MEET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def shapes_meet(batches, threshold: float, length_ratio: float):
    """Pairs of shapes (a, b, n, first, second; digits are 0) whose forms may be similar by all other characters."""
    for batch in batches:
        keep = []
        for first, second in zip(batch.column("first").to_pylist(), batch.column("second").to_pylist(), strict=True):
            x, y = Counter(first), Counter(second)
            apart = abs(x.pop("0", 0) - y.pop("0", 0)) + sum(((x - y) + (y - x)).values())
            n, m = sorted((len(first), len(second)))
            keep.append(n >= length_ratio * m - 1e-9 and apart <= (1 - threshold) * (n + m) + 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in SHAPES_MEET.names], schema=SHAPES_MEET).filter(pa.array(keep, pa.bool_()))


class _Shape:
    """Forms that differ in digits only: the text of one, the places of its digits, and the digits of all (place, form)."""

    def __init__(self, norms: pa.ChunkedArray):
        self.text = norms[0].as_py()
        self.at = [i for i, c in enumerate(self.text) if c in "0123456789"]
        octets = np.frombuffer(self.text.encode(), dtype=np.uint8)  # as many in each form
        norms = norms.cast(pa.large_string()).combine_chunks()
        start = np.frombuffer(norms.buffers()[1], dtype=np.int64)[norms.offset]
        grid = np.frombuffer(norms.buffers()[2], dtype=np.uint8, count=len(norms) * len(octets), offset=int(start))
        digit = np.flatnonzero((octets >= 48) & (octets <= 57))
        self.digits = np.ascontiguousarray(grid.reshape(len(norms), -1)[:, digit].T) - np.uint8(48)

    def spelled(self, digits: np.ndarray) -> list[str]:
        """The texts with these digits (place, text)."""
        n, length = digits.shape[1], len(self.text)
        grid = np.tile(np.array([ord(c) for c in self.text], dtype="<u4"), (n, 1))
        grid[:, self.at] = digits.T + 48
        whole = grid.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[i : i + length] for i in range(0, n * length, length)]


def _written(places: int, base: int) -> np.ndarray:
    """All numbers of ``places`` places to a base, lowest place first: (place, number)."""
    return (np.arange(base**places) // base ** np.arange(places)[:, None] % base).astype(np.uint8)


class _Patterns:
    """Characters that a form has in common with others, by how digits repeat.

    Digits of the first form are named 0, 1, ... as they come, all others of the second
    form are one more: pairs that are alike then have as many characters in common.  A
    pattern of the second form is its number to the base ``kinds + 1``.
    """

    def __init__(self, first: _Shape, second: _Shape, same: bool, least: int):
        self.first, self.second, self.same, self.least = first, second, same, least
        self.low = (len(second.at) + 1) // 2  # places looked up together
        self._known: dict = {}
        x, y = (Counter(c for c in s.text if c not in "0123456789") for s in (first, second))
        self.fixed = (x & y).total()

    def of(self, named: bytes) -> tuple:
        """Of the first form with these digits: patterns that are similar in both orders, with the lower number of the
        two, highest first; those similar in one order only, with whether it is the given one; and those where a
        higher number depends on the order, with both numbers (given order, other order; 0: not similar)."""
        if named not in self._known:
            self._known[named] = self._find(np.frombuffer(named, dtype=np.uint8))
        return self._known[named]

    def _find(self, named: np.ndarray) -> tuple:
        kinds, places = int(named.max()) + 1, len(self.second.at)
        written = _written(places, kinds + 1)
        common = sum(np.minimum((written == c).sum(axis=0), int((named == c).sum())) for c in range(kinds))
        keep = common + self.fixed >= self.least
        if self.same:  # the form itself
            keep[int((named.astype(np.int64) * (kinds + 1) ** np.arange(places)).sum())] = False
        pattern = np.flatnonzero(keep)
        shown = np.where(written == kinds, 9, written).astype(np.uint8)[:, pattern]
        given, other = (np.zeros(len(pattern), dtype=np.uint8) for _ in range(2))
        for s in range(0, len(pattern), SPELLED):
            at = slice(s, s + SPELLED)
            texts = Texts(self.first.spelled(named[:, None]) + self.second.spelled(shown[:, at]))
            columns = np.arange(1, len(texts.values))
            given[at], other[at] = (_matched(texts, *pair) for pair in ((columns * 0, columns), (columns, columns * 0)))
        given, other = (np.where(x >= self.least, x, 0) for x in (given, other))
        low, high = np.minimum(given, other), np.maximum(given, other)
        both, one, uneven = low > 0, (low == 0) & (high > 0), low < high
        order = np.argsort(-low[both].astype(np.int64), kind="stable")
        step = (kinds + 1) ** self.low

        def split(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (pattern % step).astype(np.int32), (pattern // step).astype(np.int32)

        return (split(pattern[both][order]), low[both][order]), (split(pattern[one]), given[one] > 0), (
            split(pattern[uneven]), given[uneven], other[uneven])


def _matched(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [texts.matched(a[s : s + PAIRS], b[s : s + PAIRS]) for s in range(0, len(a), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _named(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits (place, form) named 0, 1, ... as they come in a form; and which digit has each name (form, name)."""
    n = digits.shape[1]
    every, names, digit_of = np.arange(n), np.full((n, 10), 255, dtype=np.uint8), np.zeros((n, len(digits)), dtype=np.uint8)
    out, kinds = np.empty_like(digits), np.zeros(n, dtype=np.uint8)
    for j, digit in enumerate(digits):
        new = names[every, digit] == 255
        names[every[new], digit[new]] = kinds[new]
        digit_of[every[new], kinds[new]] = digit[new]
        kinds += new
        out[j] = names[every, digit]
    return out, digit_of


class _Numbers:
    """Forms of a shape in their turn, counted by pattern for one set of digits; other digits are alike."""

    def __init__(self, halves: list[np.ndarray], places: int, low: int, kept: list[int]):
        base = self.base = len(kept) + 1
        code = np.full(10, base - 1)
        code[kept] = np.arange(base - 1)
        self.code, key = code, 0
        for half, first, some in zip(halves, (0, low), (low, places - low), strict=True):
            table = (code[_written(some, 10)] * base ** np.arange(first, first + some)[:, None]).sum(axis=0)
            key = key + table.astype(np.int32)[half]
        self.count = np.bincount(key, minlength=base**places).astype(np.int32)
        self.begin = np.cumsum(self.count) - self.count
        self.n = len(key)
        self.sorted = key.astype(np.int64) * self.n + np.arange(self.n)
        self.sorted.sort()

    def before(self, pattern: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """How many forms of each pattern (row, pattern) come before the turn of the row."""
        out = np.zeros(pattern.shape, dtype=np.int64)
        row, column = np.nonzero(self.count[pattern])
        asked = pattern[row, column].astype(np.int64)
        out[row, column] = np.searchsorted(self.sorted, asked * self.n + turn[row]) - self.begin[asked]
        return out


def _by_digits(first: _Shape, second: _Shape, turn: np.ndarray, same: bool, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each first form: how many second forms have ``least`` characters in common with it, and the most that one has.

    ``turn`` is how many second forms come before the first one; the second forms are in their turn.
    """
    links, best = (np.zeros(first.digits.shape[1], dtype=np.int64) for _ in range(2))
    patterns = _Patterns(first, second, same, least)
    named, digit_of = _named(first.digits)
    named = np.ascontiguousarray(named.T)
    name = (named.astype(np.int64) << 3 * np.arange(named.shape[1])).sum(axis=1)
    digits = np.bitwise_or.reduce(np.int64(1) << first.digits.astype(np.int64), axis=0)
    order = np.lexsort((name, digits, np.bitwise_count(digits)))
    places, low = len(second.at), patterns.low
    halves = [(part * 10 ** np.arange(len(part))[:, None]).sum(axis=0) for part in (second.digits[:low], second.digits[low:])]
    starts = np.flatnonzero(np.diff(digits[order], prepend=-1) | np.diff(name[order], prepend=-1))
    numbers, current = None, -1
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if digits[order[s]] != current:
            current = int(digits[order[s]])
            kept = [d for d in range(10) if current >> d & 1]
            numbers = _Numbers(halves, places, low, kept)
            parts = [_written(some, numbers.base) for some in (low, places - low)]
        (both, lower), (one, given), (uneven, ahead, behind) = patterns.of(named[order[s]].tobytes())
        step = max(1, CELLS // max(len(lower), len(given), len(ahead), numbers.base**low))
        for rows in (order[i : min(i + step, e)] for i in range(s, e, step)):
            local = np.empty((len(rows), numbers.base), dtype=np.int64)
            local[:, -1] = numbers.base - 1
            local[:, :-1] = numbers.code[digit_of[rows, : numbers.base - 1]]
            tables = [sum((local[:, c] * numbers.base ** (j + k) for j, c in enumerate(part)), np.zeros((len(rows), 1), dtype=np.int64)).astype(np.int32)
                      for k, part in zip((0, low), parts, strict=True)]

            def asked(split, own=slice(None)):
                return tables[0][own].take(split[0], axis=1) + tables[1][own].take(split[1], axis=1)

            if len(lower):
                found = numbers.count.take(asked(both))
                links[rows] += found.sum(axis=1)
                some = found > 0
                place = some.argmax(axis=1)
                best[rows] = np.where(some[np.arange(len(rows)), place], lower[place], 0)
            if len(given):
                own = asked(one)
                early = numbers.before(own, turn[rows])
                links[rows] += np.where(given, numbers.count[own] - early, early).sum(axis=1)
            for known in np.unique(best[rows]).tolist():
                more = np.flatnonzero(np.maximum(ahead, behind) > known)
                if len(more):
                    at = np.flatnonzero(best[rows] == known)
                    own = asked((uneven[0][more], uneven[1][more]), at)
                    early = numbers.before(own, turn[rows[at]])
                    reached = np.maximum(np.where(numbers.count[own] > early, ahead[more], 0), np.where(early > 0, behind[more], 0))
                    best[rows[at]] = np.maximum(known, reached.max(axis=1))
    return links, best


def counted_by_digits(table: pa.Table, threshold: float, length_ratio: float) -> pa.Table:
    """How many forms of one shape (side 1) each form of another or the same shape (side 0) is similar to, and the highest ratio.

    Few forms are compared; of many, only how their digits repeat is.
    """
    side, turn = table["side"].to_numpy(), _turns(table)
    rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    columns = columns[np.argsort(turn[columns])]
    fid = table["fid"].to_numpy()
    first, second = (_Shape(table["norm"].take(pa.array(x))) for x in (rows, columns))
    whole = len(first.text) + len(second.text)
    n, m = sorted((len(first.text), len(second.text)))
    least = next((k for k in range(1, n + 1) if 2.0 * k / whole >= threshold), 0)
    links, ratio = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    names = np.unique((_named(first.digits)[0].astype(np.int64) << 3 * np.arange(len(first.at))[:, None]).sum(axis=0))
    kinds = [max(x >> 3 * j & 7 for j in range(len(first.at))) + 1 for x in names.tolist()]
    if not least or n / m < length_ratio:
        pass
    elif len(side) <= FEW_TEXTS and len(rows) * len(columns) <= 4 * sum((k + 1) ** len(second.at) for k in kinds):
        texts = Texts(table["norm"].to_pylist())
        label = np.unique(fid, return_inverse=True)[1]
        place = np.empty(len(side), dtype=np.int64)
        place[rows] = np.arange(len(rows))
        for a, b in reaching(texts, candidates(texts, rows, columns, label, threshold, length_ratio), threshold):
            found = similar(texts, a, b, turn, threshold, length_ratio)
            hit = found > 0
            np.add.at(links, place[a[hit]], 1)
            np.maximum.at(ratio, place[a[hit]], found[hit])
    else:
        same = [c if i not in first.at else "0" for i, c in enumerate(first.text)] == [c if i not in second.at else "0" for i, c in enumerate(second.text)]
        links, best = _by_digits(first, second, np.searchsorted(turn[columns], turn[rows]), same, least)
        ratio = 2.0 * best / whole
    some = links > 0
    return pa.table([fid[rows][some], links[some], ratio[some]], schema=COUNTED)


LOWEST = pa.schema([("cluster", pa.int64()), ("similarity", pa.float64()), ("compared", pa.int64())])


def lowest_between(table: pa.Table, all_pairs: bool) -> pa.Table:
    """Lowest ratio between two tiles of a cluster (side, norm, fid, rank, first, cluster, floor, known)."""
    side = table["side"].to_numpy()
    texts = Texts(table["norm"].to_pylist())
    order = np.array(sorted(range(len(side)), key=texts.values.__getitem__))
    rows, columns = (order, order) if (side == 2).all() else (order[side[order] == 0], order[side[order] == 1])
    known, floor = table["known"][0].as_py(), table["floor"].to_numpy()
    low, compared = (known, 0) if not len(rows) or not len(columns) else lowest(
        texts, rows, columns, _turns(table), known, floor, all_pairs)
    return pa.table([table["cluster"].slice(0, 1), [low], [compared]], schema=LOWEST)


SHAPES = pa.schema([("cluster", pa.int64()), ("length", pa.int32()), ("place", pa.int32()), ("mark", pa.int32())])
FLOORS = pa.schema([("cluster", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("floor", pa.float64())])


def shapes(batches):
    """Distinct characters at each place of the texts of one length, of rows (cluster, norm); long texts are left out."""
    for batch in batches:
        values = batch.column("norm").to_pylist()
        length = np.array([len(v) for v in values], dtype=np.int64)
        kept = np.flatnonzero((length > 0) & (length < LONG))
        if not len(kept):
            continue
        length, cluster = length[kept], batch.column("cluster").to_numpy()[kept]
        points = np.frombuffer("".join([values[i] for i in kept.tolist()]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found, code = np.unique(points, return_inverse=True)
        names, name = np.unique(cluster, return_inverse=True)
        place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
        key = np.unique(((np.repeat(name * LONG + length, length)) * LONG + place) * len(found) + code)
        rest, mark = key // len(found), found[key % len(found)]
        group = rest // LONG
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[group // LONG]), *(pa.array(x.astype(np.int32)) for x in (group % LONG, rest % LONG, mark))],
            schema=SHAPES)


def floors(batches):
    """Lowest possible ratio between texts of two lengths, of rows (cluster, n, m, first, second); 0 for long texts."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            shape = [None if s is None else [frozenset(p) or None for p in s] for s in (r["first"], r["second"])]
            out.append(0.0 if None in shape else 2.0 * least_common(*shape) / (r["n"] + r["m"]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "n", "m")), pa.array(out, pa.float64())], schema=FLOORS)


def lowest_of_small(batches):
    """Lowest ratio of each cluster of rows sorted by cluster (cluster, norm, rank, first), all pairs compared."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not len(table):
            continue
        cluster = table["cluster"].to_numpy()
        begin = int(np.searchsorted(cluster, cluster[-1]))
        yield from _lowest_each(table.slice(0, begin)).to_batches()
        held = table.slice(begin)
    if held is not None:
        yield from _lowest_each(held).to_batches()


def _lowest_each(table: pa.Table) -> pa.Table:
    found, start, size = np.unique(table["cluster"].to_numpy(), return_index=True, return_counts=True)
    texts, turn = Texts(table["norm"].to_pylist()), _turns(table) if len(table) else None
    low, compared = np.ones(len(found)), size * (size - 1) // 2
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        if not len(i):
            continue
        own = np.flatnonzero(size == n)
        step = max(1, 4 * PAIRS // len(i))
        for s in range(0, len(own), step):
            at = start[own[s : s + step]]
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            swap = turn[a] > turn[b]
            ratio = texts.ratios(np.where(swap, b, a), np.where(swap, a, b))
            low[own[s : s + step]] = ratio.reshape(len(at), len(i)).min(axis=1)
    return pa.table([found, low, compared], schema=LOWEST)
