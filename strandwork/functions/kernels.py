"""Sequence kernels for Arrow-batched functions: infix edit distance, local alignment, fuzzy primers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

# Local alignment scores (match, mismatch, gap open, gap extend).
SCORES = (2.0, -3.0, -5.0, -2.0)
IDENTITY_SCORES = (1.0, 0.0, -1.0, -0.5)


def infix_distance(query: str, target: str, bound: int = -1) -> int:
    """Least edits to turn query into any substring of target; -1 beyond bound (if not negative).

    Bit-parallel dynamic programming with whole columns in one Python integer.
    """
    m = len(query)
    if not m:
        return 0
    place: dict[str, int] = {}
    for i, ch in enumerate(query):
        place[ch] = place.get(ch, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for ch in target:
        eq = place.get(ch, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (~(x | up) & mask), up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & mask, (fall << 1) & mask
        v = eq | down
        up, down = fall | (~(v | rise) & mask), rise & v
        best = min(best, score)
    return best if bound < 0 or best <= bound else -1


def local_score(a: str, b: str, scores: tuple[float, float, float, float] = SCORES) -> float:
    """Best local alignment score with affine gaps, row by row; a gap of length L costs open + extend * (L - 1)."""
    match, mismatch, open_, extend = scores
    if not a or not b:
        return 0.0
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n = len(y)
    h, up = np.zeros(n + 1), np.full(n + 1, -np.inf)
    slope = extend * np.arange(n + 1)
    best = 0.0
    for ch in a:
        up = np.maximum(up + extend, h + open_)
        step = np.zeros(n + 1)
        step[1:] = np.maximum(0.0, np.maximum(h[:-1] + np.where(y == ord(ch), match, mismatch), up[1:]))
        # a gap along b that begins at j and ends at k costs open + extend * (k - j - 1)
        run = np.maximum.accumulate(step - slope)
        left = np.full(n + 1, -np.inf)
        left[1:] = run[:-1] + open_ - extend + slope[1:]
        h = np.maximum(step, left)
        h[0] = 0.0
        best = max(best, float(h.max()))
    return best


def _pieces(m: int, n: int, longest: int) -> list[tuple[int, int]]:
    """Parts of a target, one of which holds whatever a query of m letters is aligned with.

    An infix has at most 2 * m letters, if a further one costs more than it gives.
    """
    if n <= longest * m + 64:
        return [(0, n)]
    size, over = longest * m + 64, 2 * m + 2
    return [(at, min(n, at + size)) for at in range(0, n - over, size - over)]


def compare(queries: list[str], targets: list[str], edits: bool = True, local: bool = True, scores: tuple[float, float, float, float] = SCORES, cells: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """infix_distance() and local_score() of each pair, or zeros; many pairs are swept at a time, one antidiagonal a step.

    Long targets are swept in pieces, and the best of these counts.
    """
    assert all(float(x).is_integer() for x in scores) and scores[0] <= -scores[3]
    pieces = [(i, a, b) for i, (q, t) in enumerate(zip(queries, targets, strict=True)) for a, b in _pieces(len(q), len(t), 16)]
    if len(pieces) == len(queries):
        return _sweep(queries, targets, edits, local, scores, cells)
    of = np.array([i for i, _, _ in pieces])
    d, s = _sweep([queries[i] for i in of], [targets[i][a:b] for i, a, b in pieces], edits, local, scores, cells)
    first = np.searchsorted(of, np.arange(len(queries)))
    return np.minimum.reduceat(d, first), np.maximum.reduceat(s, first)


def _sweep(queries: list[str], targets: list[str], edits: bool, local: bool, scores: tuple[float, float, float, float], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """compare() of whole targets.

    Queries are padded in front with rows that cost nothing, and a code that matches nothing stands before and behind the targets.
    """
    match, mismatch, open_, extend = (int(x) for x in scores)
    distances, best_scores = np.zeros(len(queries), np.int32), np.zeros(len(queries))
    order = sorted(range(len(queries)), key=lambda i: (round(3 * np.log2(len(targets[i]) + 50)), len(queries[i]), len(targets[i])))
    codes = np.zeros(0x110000, np.int32)
    at = 0
    while at < len(order):
        longest = max(len(queries[order[at]]), 1)
        few = max(16, min(256, cells // longest))
        some = order[at : at + few]
        kind = round(3 * np.log2(len(targets[some[0]]) + 50))
        some = [i for i in some if round(3 * np.log2(len(targets[i]) + 50)) == kind]  # of like length
        at += len(some)
        if len(some) < 3:  # too few for a sweep
            for i in some:
                distances[i] = infix_distance(queries[i], targets[i]) if edits else 0
                best_scores[i] = local_score(queries[i], targets[i], scores) if local else 0.0
            continue
        p, m, n = len(some), max(1, *(len(queries[i]) for i in some)), max(len(targets[i]) for i in some)
        points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.unique(np.concatenate([points(queries[i]) for i in some]))
        scale = 1 << (match - mismatch).bit_length()  # so that two codes differ by more than a mismatch costs
        kind = np.int16 if max(m * max(match, -mismatch, -open_), (len(letters) + 1) * scale) < 30_000 else np.int32
        pad = np.iinfo(kind).max
        codes[letters] = np.arange(1, len(letters) + 1) * scale
        q, turned = np.full((m, p), pad, kind), np.zeros((n + 2 * m, p), kind)
        rest = np.zeros((m + 1, p), kind)  # the least edits of each row before the target begins
        for c, i in enumerate(some):
            a, b = len(queries[i]), len(targets[i])
            q[m - a :, c] = codes[points(queries[i])]
            turned[m + n - b : m + n, c] = codes[points(targets[i])][::-1]
            rest[m - a :, c] = np.arange(a + 1)
        codes[letters] = 0
        cap = np.where(rest[1:] > 0, pad, 0).astype(kind) if (rest[1] == 0).any() else None
        differ, step, step_cost = (np.empty((m, p), kind) for _ in range(3))
        d0, d1, d2, least = rest.copy(), rest.copy(), rest.copy(), rest[m].copy()
        h0, h1, h2, best = (np.zeros((m + 1, p), kind) for _ in range(4))
        gap_open = np.empty((m + 1, p), kind)
        left = np.full((m, p), open_, kind)
        up, up_next = left.copy(), np.full((m, p), open_, kind)
        one, floor = kind(1), kind(0)
        open_k, extend_k, match_k, gain = kind(open_), kind(extend), kind(match), kind(match - mismatch)
        for s in range(2, m + n + 1):
            np.bitwise_xor(q, turned[m + n - s + 1 : 2 * m + n - s + 1], out=differ)
            if edits:
                np.minimum(differ, one, out=step_cost)
                d0, d1, d2 = d2, d0, d1
                new = d0[1:]
                np.minimum(d1[1:], d1[:-1], out=step)
                step += one
                np.add(d2[:-1], step_cost, out=new)
                np.minimum(new, step, out=new)
                if cap is not None:
                    np.minimum(new, cap, out=new)
                np.minimum(least, d0[m], out=least)
            if local:
                h0, h1, h2 = h2, h0, h1
                new = h0[1:]
                np.add(h1, open_k, out=gap_open)
                left += extend_k
                np.maximum(left, gap_open[1:], out=left)
                up += extend_k
                np.maximum(up[:-1], gap_open[1:-1], out=up_next[1:])
                up_next[0] = open_k
                up, up_next = up_next, up
                np.minimum(differ, gain, out=differ)
                np.subtract(h2[:-1], differ, out=new)
                new += match_k
                np.maximum(new, left, out=new)
                np.maximum(new, up, out=new)
                np.maximum(new, floor, out=new)
                np.maximum(best, h0, out=best)
        if edits:
            distances[some] = least
        if local:
            best_scores[some] = best.max(0)
    return distances, best_scores


def _rows(a: str, y: np.ndarray, scores: tuple[float, float, float, float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, e, f) of each row of the local alignment of a with the code points y; a gap's opening costs no less than its extension."""
    match, mismatch, open_, extend = scores
    n = len(y)
    h, up, slope = np.zeros(n + 1), np.full(n + 1, -np.inf), extend * np.arange(n + 1)
    for ch in a:
        up = np.maximum(up + extend, h + open_)
        up[0] = -np.inf
        step = np.zeros(n + 1)
        step[1:] = np.maximum(0.0, np.maximum(h[:-1] + np.where(y == ord(ch), match, mismatch), up[1:]))
        left = np.full(n + 1, -np.inf)
        left[1:] = np.maximum.accumulate(step - slope)[:-1] + open_ - extend + slope[1:]
        h = np.maximum(step, left)
        h[0] = 0.0
        yield h, left, up


def local_alignment(a: str, b: str, scores: tuple[float, float, float, float] = SCORES) -> dict[str, float]:
    """Score, matches, columns, identity and the aligned place in b; ties go diagonal, then up, then left.

    Only one row of the whole of b is held; the way back is found in a window that no alignment of a's prefix can leave.
    """
    match, mismatch, open_, extend = scores
    assert open_ <= extend < 0
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    spans = _pieces(len(a), len(b), 8) if all(float(x).is_integer() for x in scores) and match <= -extend else [(0, len(b))]
    if len(spans) < 16:  # too few for a sweep
        spans = [(0, len(b))]
    else:  # only those that reach the score
        best = compare([a] * len(spans), [b[lo:hi] for lo, hi in spans], edits=False, scores=scores)[1]
        spans = [x for x, s in zip(spans, best, strict=True) if s == best.max() > 0]
    score, i, end = 0.0, 0, 0
    for lo, hi in spans:
        for k, (row, _, _) in enumerate(_rows(a, y[lo:hi], scores), 1):
            at = int(row.argmax())
            if row[at] > score or row[at] == score > 0 and (k, lo + at) < (i, end):
                score, i, end = float(row[at]), k, lo + at
    # matches are at most i, and a column of a gap takes at least -extend of what they give
    low = max(0, end - i - int(match * i / -extend) - 1)
    b, j = b[low:end], end - low
    h, e, f = np.zeros((i + 1, j + 1)), np.full((i + 1, j + 1), -np.inf), np.full((i + 1, j + 1), -np.inf)
    for k, (row, left, up) in enumerate(_rows(a[:i], y[low:end], scores), 1):
        h[k], e[k], f[k] = row, left, up
    same = columns = 0
    state = "h"
    while state != "h" or h[i, j] > 0:
        if state == "h":
            if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                same += a[i - 1] == b[j - 1]
                columns += 1
                i, j = i - 1, j - 1
            else:
                state = "f" if h[i, j] == f[i, j] else "e"
        elif state == "f":
            columns += 1
            state = "h" if f[i, j] == h[i - 1, j] + open_ else "f"
            i -= 1
        else:
            columns += 1
            state = "h" if e[i, j] == h[i, j - 1] + open_ else "e"
            j -= 1
    return {"score": score, "n_matches": int(same), "aligned_len": int(columns), "identity": same / columns if columns else 0.0, "ref_start": int(low + j), "ref_end": end}


def fuzzy_find(pattern: str, sequence: str, edits: int, start: int = 0) -> tuple[int, int, int] | None:
    """(start, end, edits) of the leftmost match with at most so many edits; an exact match is tried first."""
    import regex

    if m := regex.compile(pattern).search(sequence, start):
        return m.start(), m.end(), 0
    if edits and (m := regex.compile(f"(?:{pattern}){{e<={edits}}}").search(sequence, start)):
        return m.start(), m.end(), sum(m.fuzzy_counts)
    return None


class Primer:
    """fuzzy_find() of one primer in many sequences.

    A match with e edits holds one of e + 1 pieces of the primer unchanged, at most e places off; only starts near such a piece are tried.
    """

    def __init__(self, letters: str, pattern: str, edits: int) -> None:
        import regex

        self.edits = edits
        self.exact = re.compile(pattern)
        self.fuzzy = regex.compile(f"(?:{pattern}){{e<={edits}}}")
        codes = re.findall(r"\[[^]]*\]|.", pattern)
        assert len(codes) == len(letters)
        cuts = [round(k * len(codes) / (edits + 1)) for k in range(edits + 2)]
        self.pieces = [(a, re.compile(f"(?=({''.join(codes[a:b])}))")) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def find(self, sequence: str, start: int = 0) -> tuple[int, int, int] | None:
        if m := self.exact.search(sequence, start):
            return m.start(), m.end(), 0
        if not self.edits:
            return None
        starts: set[int] = set()
        for offset, piece in self.pieces:
            for m in piece.finditer(sequence, start):
                starts.update(range(m.start() - offset - self.edits, m.start() - offset + self.edits + 1))
        for at in sorted(starts):
            if at >= start and self.fuzzy.match(sequence, at):
                m = self.fuzzy.search(sequence, max(start, at - 1))  # a search takes no inserted letter where it begins
                return m.start(), m.end(), sum(m.fuzzy_counts)
        return None
