"""A whole context tree in one place, to compare the distributed one with. Codes have the oldest byte first."""

from __future__ import annotations

import numpy as np

from ledgerline.llm.ctw import DEPTH, byte_stream, log_kt


def grams(texts):
    """Distinct (context, byte) codes and their counts."""
    data, starts, ends = byte_stream(texts)
    out = {}
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        for i in range(a, b):
            code = int.from_bytes(data[i - DEPTH : i + 1].tobytes(), "big")
            out[code] = out.get(code, 0) + 1
    keys = np.array(sorted(out), np.uint64)
    return keys, np.array([out[int(k)] for k in keys], np.int64)


def _predict(n0: np.ndarray, n1: np.ndarray, levels: list[np.ndarray], parent: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The mixed probability of a one at every context (rows) and decision (columns)."""
    own = log_kt(n0, n1)
    weighted = own.copy()
    below = np.zeros_like(own)
    for d in range(len(levels) - 1, 0, -1):
        np.add.at(below, parent[levels[d]], weighted[levels[d]])
        inner = levels[d - 1][~leaf[levels[d - 1]]]
        weighted[inner] = np.logaddexp(own[inner], below[inner]) - np.log(2)
    stay = np.where(leaf[:, None], 1.0, np.minimum(np.exp(np.minimum(own - weighted, 0.6931471805599453)) / 2, 1.0))
    ahead, p1 = np.ones_like(own), np.zeros_like(own)
    kt = (n1 + 0.5) / (n0 + n1 + 1)
    for d, rows in enumerate(levels):
        if d:
            ahead[rows] = ahead[parent[rows]] * (1 - stay[parent[rows]])
            p1[rows] = p1[parent[rows]]
        p1[rows] += ahead[rows] * stay[rows] * kt[rows]
    return np.clip(p1, 1e-12, 1 - 1e-12)


class ContextTree:
    """``child``: each context's next by one more byte back, itself at a leaf. ``logp``: log10 probability of each byte."""

    def __init__(self, entries: dict[int, tuple[np.ndarray, np.ndarray]], root: np.ndarray):
        """``entries[d]``: kept (context code << 8 | byte, count) of depth d; ``root``: counts of the bytes."""
        counts, parent_of = [root.astype(np.float64)], [-1]
        depth_of, codes = [0], {(0, 0): 0}
        child = [np.full(256, -1, np.int64)]
        for d in range(1, DEPTH + 1):
            keys, n = entries.get(d, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            ctx = (keys >> np.uint64(8)).astype(np.uint64)
            start = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else []
            ends = np.r_[start[1:], len(ctx)] if len(ctx) else []
            for a, b in zip(start, ends, strict=True):
                c = int(ctx[a])
                parent = codes.get((d - 1, c & ((1 << (8 * (d - 1))) - 1)))
                if parent is None:
                    continue
                own = np.zeros(256)
                own[(keys[a:b] & np.uint64(255)).astype(np.int64)] = n[a:b]
                number = len(counts)
                codes[d, c] = number
                counts.append(own), depth_of.append(d), parent_of.append(parent), child.append(np.full(256, -1, np.int64))
                child[parent][c >> (8 * (d - 1))] = number
        # contexts that were not kept share one leaf under their parent
        for p in range(len(counts)):
            kids = child[p][child[p] >= 0]
            if len(kids):
                rest = np.maximum(counts[p] - sum(counts[k] for k in kids), 0)
                number = len(counts)
                counts.append(rest), depth_of.append(depth_of[p] + 1), parent_of.append(p), child.append(np.full(256, number, np.int64))
                child[p][child[p] < 0] = number
            else:
                child[p][:] = p
        depth, parent = np.array(depth_of), np.array(parent_of)
        counts = np.stack(counts).astype(np.float32)
        self.child = np.stack(child).astype(np.int32)
        leaf = self.child[:, 0] == np.arange(len(child))
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        self.logp = np.zeros((len(counts), 256), np.float32)
        # decisions are independent of each other, so a few nodes of the byte tree are in memory at a time
        for level in range(8):
            width = 256 >> level
            for a in range(0, 1 << level, 16):
                nodes = counts[:, a * width : (a + 16) * width].reshape(len(counts), -1, 2, width // 2).sum(3, dtype=np.float64)
                p1 = _predict(nodes[:, :, 0], nodes[:, :, 1], levels, parent, leaf)
                zero, one = np.log10(1 - p1).astype(np.float32), np.log10(p1).astype(np.float32)
                part = self.logp[:, a * width : (a + 16) * width].reshape(len(counts), -1, 2, width // 2)
                part[:, :, 0] += zero[:, :, None]
                part[:, :, 1] += one[:, :, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text's bytes and its end."""
        data, starts, ends = byte_stream(texts)
        child, logp = self.child.ravel(), self.logp.ravel()
        n = len(data)
        node = child[data[DEPTH - 1 : n - 1].astype(np.int32)]
        for d in range(2, DEPTH + 1):
            node = child[(node << 8) + data[DEPTH - d : n - d]]
        lp = logp[(node << 8) + data[DEPTH:]].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(lp)])
        return total[ends - DEPTH] - total[starts - DEPTH]
