"""External induced sorting: suffix and common-prefix arrays of a text by bulk queues.

The sorted order of the leftmost S-type (LMS) suffixes, found by naming LMS substrings and sorting
the reduced text, induces the order of all L-type suffixes in one ascending pass and of all S-type
suffixes in one descending pass. Both passes are priority-queue algorithms in which a tuple waits
under its first symbol and leaves in the order it came, so the queue is one first-in-first-out
lane per symbol. Lanes move in bulk: a step takes all that waits in a lane, which can add to the
same lane only through runs of one symbol. Common-prefix lengths travel with the tuples: a tuple's
length with its predecessor in a lane is one more than the least length among the sources between
the two, a range minimum over the step plus a running minimum per lane across steps.

Lanes keep ``memory`` bytes and spill what is beyond to one scratch file of the task, in the order
of arrival, so queues far larger than memory pass through it. Prefix lengths are capped.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Lanes:
    """First-in-first-out lanes of (position, prefix length) arrays, with a bound on memory."""

    def __init__(self, n: int, memory: int, folder: str | None = None):
        self.lanes: list[list] = [[] for _ in range(n)]
        self.memory, self.held, self.folder, self.file = memory, 0, folder, None

    def put(self, lane: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.lanes[lane].append((at, len(pos)))
        else:
            self.held += size
            self.lanes[lane].append((pos, lcp))

    def take(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for a, b in self.lanes[lane]:
            if isinstance(a, int):
                self.file.seek(a)
                parts.append((np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(b), np.uint8)))
            else:
                self.held -= a.nbytes + b.nbytes
                parts.append((a, b))
        self.lanes[lane] = []
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type (less than its successor); the last one is."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    s = np.ones(n, bool)
    s[:-1] = np.where(nxt < n, step[np.minimum(nxt, n - 2)] > 0, True) if n > 1 else s[:-1]
    return s


def _words(t: np.ndarray, pad: int = 0) -> np.ndarray:
    """At every place, the next four symbols as one number."""
    x = np.concatenate([t, np.full(4, pad, t.dtype)]).astype(np.uint64)
    n = len(t)
    return x[:n] << np.uint64(48) | x[1 : n + 1] << np.uint64(32) | x[2 : n + 2] << np.uint64(16) | x[3 : n + 3]


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Capped common-prefix lengths of pairs of suffixes, four symbols at a time."""
    n = len(words)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    done = 0
    while len(live) and done < cap:
        x, y = a[live] + done, b[live] + done
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        diff = words[x] ^ words[y]
        same = diff == 0
        out[live[same]] = done + 4
        lead = np.select([diff >> np.uint64(48) != 0, diff >> np.uint64(32) != 0, diff >> np.uint64(16) != 0], [0, 1, 2], 3)
        out[live[~same]] = done + lead[~same]
        live = live[same]
        done += 4
    return np.minimum(out, cap)


def _sorted_lms(t: np.ndarray, lms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """LMS suffixes in order: substrings named by radix refinement, the reduced text by doubling."""
    m = len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    # symbols beyond a substring's end count as larger than any: a proper prefix is the larger one
    name = np.zeros(m, np.int64)
    live, done = np.arange(m), 0
    while len(live):
        left = length[live] - done
        raw = words[np.minimum(lms[live] + done, len(words) - 1)]
        fill = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(16) * np.clip(left, 0, 3).astype(np.uint64))
        key = np.where(left >= 4, raw, np.where(left <= 0, np.uint64(0xFFFFFFFFFFFFFFFF), raw | fill))
        order = np.argsort(key, kind="stable") if not done else np.lexsort((key, name[live]))
        g, k = name[live][order], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        start = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
        sub = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        name[live[order]] = g + (sub - start)  # names leave room for a group's members
        done += 4
        size = np.diff(np.append(np.flatnonzero(new), len(g)))
        many = np.repeat(size > 1, size)
        tail = np.maximum.reduceat(length[live[order]], np.flatnonzero(new)) > done
        live = live[order][many & np.repeat(tail, size)]
    order = np.argsort(name, kind="stable")
    sa, r = order, name[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    rank = np.empty(m, np.int64)  # of a group: the place of its first member
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    h = 1
    while True:  # only members of groups that are not yet told apart are sorted again
        size = np.diff(np.append(np.flatnonzero(new), m))
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            return lms[sa]
        who = sa[at]
        after = np.where(who + h < m, rank[np.minimum(who + h, m - 1)] + 1, 0)
        order = np.argsort(rank[who] << 32 | after, kind="stable")
        who, after = who[order], after[order]
        own = rank[who]
        sa[at] = who
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        new[at] = split
        rank[who] = np.maximum.accumulate(np.where(split, at, 0))
        h *= 2


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of v[lo..hi] (inclusive) for many ranges, by a sparse table of bytes."""
    out = np.empty(len(lo), np.uint8)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table, k = v, 0
    top = int(level.max()) if len(level) else -1
    while k <= top:
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << k) + 1])
        if k < top:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1
    return out


class _Inducer:
    """One pass: takes sorted sources in bulk, puts what they induce into lanes."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, lanes: Lanes, cap: int):
        self.t, self.wanted, self.lanes, self.cap = t, wanted, lanes, cap
        self.least = np.full(int(t.max()) + 1, 0, np.uint8)  # since the last put into each lane; 0 before the first
        self.used = np.zeros(len(self.least), bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """pos in order; lcp[i] is with the source before it, over all sources fed so far."""
        if not len(pos):
            return
        before = pos - 1
        ok = np.flatnonzero((pos > 0) & self.wanted[np.maximum(before, 0)])
        if not len(ok):
            np.minimum(self.least, lcp.min(), out=self.least)
            return
        target = self.t[before[ok]].astype(np.int64)
        order = np.argsort(target, kind="stable")
        src, target = ok[order], target[order]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        prev = np.concatenate([[-1], src[:-1]])
        lo = np.where(first, 0, prev + 1)
        got = _range_min(lcp, lo, src)
        got = np.where(first, np.minimum(got, self.least[target]), got)
        got = np.where(first & ~self.used[target], 0, np.minimum(got.astype(np.int64) + 1, self.cap)).astype(np.uint8)
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(src))
        np.minimum(self.least, lcp.min(), out=self.least)
        for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
            c = int(target[a])
            self.lanes.put(c, before[src[a:b]], got[a:b])
            rest = lcp[src[b - 1] + 1 :]
            self.least[c] = rest.min() if len(rest) else self.cap
            self.used[c] = True


def suffix_array(text: np.ndarray, cap: int = 50, memory: int = 64 << 20, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte (or small symbol) text in order, and each one's capped common prefix with the one before."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    t = np.concatenate([text.astype(np.uint16) + 1, [0]]).astype(np.uint16)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    words = _words(t)
    order = _sorted_lms(t, lms, words)
    lms_lcp = np.zeros(len(order), np.uint8)
    lms_lcp[1:] = common_prefix(words, order[:-1], order[1:], cap)
    lms_at = np.searchsorted(t[order], np.arange(int(t.max()) + 2))
    sigma = int(t.max()) + 1

    def joint(a: int, b: int) -> int:
        return int(common_prefix(words, np.array([a]), np.array([b]), cap)[0])

    lanes = Lanes(sigma, memory, folder)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    up = _Inducer(t, ~s, lanes, cap)
    for c in range(sigma):
        got_pos, got_lcp = [], []
        while lanes.lanes[c]:
            pos, lcp = lanes.take(c)
            up.feed(pos, lcp)
            got_pos.append(pos)
            got_lcp.append(lcp)
        pos = np.concatenate(got_pos) if got_pos else np.zeros(0, np.int64)
        done.append((pos, np.concatenate(got_lcp) if got_lcp else np.zeros(0, np.uint8)))
        own = slice(lms_at[c], lms_at[c + 1])
        if own.start < own.stop:
            lcp = lms_lcp[own].copy()
            lcp[0] = joint(int(pos[-1]), int(order[own.start])) if len(pos) else 0
            up.feed(order[own], lcp)
    lanes.close()

    lanes = Lanes(sigma, memory, folder)
    down = _Inducer(t, s, lanes, cap)
    out_pos, out_lcp = [], []
    for c in range(sigma - 1, -1, -1):
        got_pos, got_lcp = [], []
        while lanes.lanes[c]:
            pos, lcp = lanes.take(c)
            down.feed(pos, lcp)
            got_pos.append(pos)
            got_lcp.append(lcp)
        s_pos = np.concatenate(got_pos) if got_pos else np.zeros(0, np.int64)
        s_lcp = np.concatenate(got_lcp) if got_lcp else np.zeros(0, np.uint8)
        if c == 0:  # the end of the text
            s_pos, s_lcp = np.array([n]), np.zeros(1, np.uint8)
            down.feed(s_pos, s_lcp)
        l_pos, l_lcp = done[c]
        seam = joint(int(l_pos[-1]), int(s_pos[-1])) if len(l_pos) and len(s_pos) else 0
        if len(l_pos):  # from right to left, a length belongs to the pair with the right neighbour
            back = np.concatenate([[seam], l_lcp[1:][::-1]]).astype(np.uint8)
            down.feed(l_pos[::-1], back)
        if len(s_pos):
            right = s_lcp[::-1]  # of the pair (this, next to the right); the last of them ends the bucket
            out_pos.append(s_pos[::-1])
            out_lcp.append(np.concatenate([[seam if len(l_pos) else 0], right[:-1]]).astype(np.uint8))
        if len(l_pos):
            out_pos.append(l_pos)
            out_lcp.append(l_lcp)
    lanes.close()
    sa, lcp = np.concatenate(out_pos[::-1]), np.concatenate(out_lcp[::-1])
    return sa[1:], np.concatenate([[0], lcp[2:]]).astype(np.uint8)
