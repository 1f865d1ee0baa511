"""Recompression of word sequences: named runs and pairs, round by round.

A round first names every maximal run of one symbol, then every pair of a
left-class and a right-class symbol (the class is one bit of the name). Names
are hashes of what they stand for, so they are the same in every document,
task and machine: the naming is global without a table of names to pass
around. 64-bit names only reveal candidates; equality is decided later on
128-bit hashes of the words themselves.

Each symbol carries, beside the words it covers, its *context*: the words
which alone decide that this symbol appears here. Wherever the same context
stands, in any document, the same symbol stands at the same place. So a
window of words holds, at every level, exactly the symbols whose context lies
inside it, and equal windows hold equal symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from flightlens.llm.wordhash import U64, mix, window_hashes

_RUN = U64(0xD6E8FEB86659FD93)
_PAIR = U64(0xA0761D6478BD642F)
_HALF = U64(0xE7037ED1A0B428DB)
OUTSIDE = 1 << 40        # a context that reaches past its document fits no window


@dataclass
class Level:
    name: np.ndarray       # uint64
    begin: np.ndarray      # first word
    end: np.ndarray        # word after the last
    left: np.ndarray       # first word of the context
    right: np.ndarray      # word after the last of the context

    def take(self, keep: np.ndarray) -> "Level":
        return Level(self.name[keep], self.begin[keep], self.end[keep], self.left[keep], self.right[keep])


def base_level(words: np.ndarray) -> Level:
    at = np.arange(len(words), dtype=np.int64)
    return Level(words, at, at + 1, at, at + 1)


def name_runs(s: Level, words: np.ndarray, first: np.ndarray, doc: np.ndarray) -> Level:
    """One symbol for each maximal run of equal symbols of a document.

    That the run ends is shown by one word outside it, where that word differs
    from the one a further copy would have there; else by the whole neighbour.
    """
    n = len(s.name)
    if n == 0:
        return s
    of = doc[s.begin]
    new = np.ones(n, dtype=bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], n) - 1
    count = last - head + 1
    name = s.name[head]
    if len(head) < n:
        name = np.where(count > 1, mix(name * _RUN + count.astype(U64)), name)
    begin, end = s.begin[head], s.end[last]
    lo, hi = first[of[head]], first[of[head] + 1]
    at_lo, at_hi = begin == lo, end == hi
    # one word before / after the run
    before = words[np.maximum(begin - 1, 0)] != words[s.end[head] - 1]
    after = words[np.minimum(end, len(words) - 1)] != words[begin]
    near_l = np.where(before, begin - 1, s.left[np.maximum(head - 1, 0)])
    near_r = np.where(after, end + 1, s.right[np.minimum(last + 1, n - 1)])
    left = np.minimum(s.left[head], np.where(at_lo, lo - OUTSIDE, near_l))
    right = np.maximum(s.right[last], np.where(at_hi, hi + OUTSIDE, near_r))
    return Level(name, begin, end, left, right)


def name_pairs(s: Level, first: np.ndarray, doc: np.ndarray, level: int) -> Level:
    """One symbol for each left-class symbol followed by a right-class one."""
    n = len(s.name)
    if n == 0:
        return s
    is_right = (mix(s.name + np.array([level], dtype=U64) * _PAIR) & U64(1)).astype(bool)
    of = doc[s.begin]
    same = of[1:] == of[:-1]
    joins = np.zeros(n, dtype=bool)            # with the next symbol
    joins[:-1] = ~is_right[:-1] & is_right[1:] & same
    joined = np.zeros(n, dtype=bool)           # with the one before
    joined[1:] = joins[:-1]
    alone = ~joins & ~joined
    left, right = s.left.copy(), s.right.copy()
    # a single symbol depends on the neighbour that might have joined it
    ask_r, ask_l = alone & ~is_right, alone & is_right
    nxt = np.append(s.right[1:], 0)
    prv = np.insert(s.left[:-1], 0, 0)
    has_next, has_prev = np.append(same, False), np.insert(same, 0, False)
    right = np.where(ask_r, np.maximum(right, np.where(has_next, nxt, first[of + 1] + OUTSIDE)), right)
    left = np.where(ask_l, np.minimum(left, np.where(has_prev, prv, first[of] - OUTSIDE)), left)
    name, end = s.name.copy(), s.end.copy()
    a = np.flatnonzero(joins)
    b = a + 1
    name[a] = mix(mix(s.name[a] * _PAIR + s.name[b]) + U64(level))
    end[a] = s.end[b]
    left[a] = np.minimum(s.left[a], s.left[b])
    right[a] = np.maximum(s.right[a], s.right[b])
    return Level(name, s.begin, end, left, right).take(~joined)


def levels(words: np.ndarray, first: np.ndarray, width: int, most: int):
    """Yield the levels of all documents at once; ``first`` holds their word offsets.

    Ends after ``most`` rounds, or when no symbol's context fits into ``width`` words.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = base_level(words)
    k = 0
    while len(s.name) and (s.right - s.left <= width).any():
        yield s
        if k == most:
            return
        s = name_runs(s, words, first, doc)
        if not (s.right - s.left <= width).any():
            return
        s = name_pairs(s, first, doc, k)
        k += 1


def _halves(words: np.ndarray, first: np.ndarray, doc: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, hashes of the ``half`` words before it and of the ``half`` words from it on."""
    h = window_hashes(words, half, 0x9E3779B97F4A7C15)
    before, after = np.zeros(len(words) + 1, dtype=U64), np.zeros(len(words) + 1, dtype=U64)
    after[:len(h)] = h
    before[half:half + len(h)] = ~h
    return before, after


def anchors(words: np.ndarray, first: np.ndarray, width: int,
            most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, from, to): one high-level symbol inside each window.

    Window ``p`` covers words ``p .. p + width - 1`` of one document. It is
    given the symbol with the smallest name (the first of equals) among those
    of the highest level inside it whose context takes at most half a window;
    level 0, the words, always has one. ``from .. to`` are the starts of the
    windows that were given this symbol. The choice depends on the window's
    words alone. The name returned joins the symbol's with a hash of the half
    window beside the front of its context that lies inside the window, which
    verifies most of it; so equal windows, wherever they stand, are given equal
    names, and others seldom are.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    free = np.zeros(n + 1, dtype=bool)          # windows without a symbol so far
    for d in np.flatnonzero(np.diff(first) >= width):
        free[first[d]:first[d + 1] - width + 1] = True
    names, froms, tos = [], [], []
    left_hash, right_hash = _halves(words, first, doc, width // 2)
    for s in reversed(list(levels(words, first, width // 2, most))):
        total = np.zeros(n + 2, dtype=np.int32)
        np.cumsum(free, out=total[1:])
        if not total[-1]:
            break
        fits = np.flatnonzero(s.right - s.left <= width // 2)
        of = doc[s.begin[fits]]
        lo, hi = np.maximum(s.right[fits] - width, first[of]), np.minimum(s.left[fits], first[of + 1] - width)
        use = lo <= hi
        use[use] = total[hi[use] + 1] > total[lo[use]]
        name, lo, hi, left = s.name[fits][use], lo[use], hi[use], s.left[fits][use]
        frm, to = lo.copy(), hi.copy()
        step = 1
        while step < len(name):                  # symbols seen together by some window
            near = hi[:-step] >= lo[step:]
            if not near.any():
                break
            won = name[:-step] <= name[step:]    # the earlier of the two wins
            a = np.flatnonzero(near & won) + step
            frm[a] = np.maximum(frm[a], hi[a - step] + 1)
            b = np.flatnonzero(near & ~won)
            to[b] = np.minimum(to[b], lo[b + step] - 1)
            step += 1
        # a window that starts within half a window before the context holds the half window
        # from there on, any other one holds the half window up to there
        split = left - width // 2
        for side, f, t in ((right_hash, np.maximum(frm, split + 1), to), (left_hash, frm, np.minimum(to, split))):
            keep = np.flatnonzero(f <= t)
            keep = keep[total[t[keep] + 1] > total[f[keep]]]
            names.append(mix(name[keep] * _HALF + side[left[keep]]))
            froms.append(f[keep])
            tos.append(t[keep])
        mark = np.zeros(n + 2, dtype=np.int32)
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi + 1, -1)
        free[np.cumsum(mark)[:n + 1] > 0] = False
    if not names:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=U64), none, none
    return np.concatenate(names), np.concatenate(froms), np.concatenate(tos)
