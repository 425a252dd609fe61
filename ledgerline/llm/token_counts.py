"""Exact token counts at every prefix by dynamic programming.

In byte-pair encoding the last token of a prefix decides the rest: for each end ``i`` exactly one vocabulary token that
ends there goes with the last token of the prefix before it, and ``count[i] = count[i - len] + 1``. Two tokens go
together when encoding their joined bytes gives the two back, that is, when no pair across the border would have been
merged while both its halves still stood at the border. So one pass over a piece gives its count at every byte, and
truncation and budget questions need no further encoding.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import split_pattern
from .common import map_columns, table

MODEL_FILE = "byte_bpe_50k.json"
CACHE_PIECES = 400_000
_FOREVER = 1 << 40
_RUNS = regex.compile(r"\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = sorted(special, key=len, reverse=True)
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        ids = {raw(k): v for k, v in vocab.items()}
        self.pattern = split_pattern(pattern)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x << 20 | y, r)
            parts.setdefault(z, (x, y, r))
        self.parts = parts
        # spines: the tokens that stand at a token's left or right border while it grows, each with the rank that ends it
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for side, at in ((self.left, 0), (self.right, 1)):
            for t in ids.values():
                line, end, x = [], _FOREVER, t
                while True:
                    line.append((x, end))
                    if x not in parts:
                        break
                    end = parts[x][2]
                    x = parts[x][at]
                side[t] = line
        self.known: dict[int, bool] = {}
        self.ids = {b: t for b, t in ids.items() if len(b) == 1 or self._whole(t)}
        self.longest = max(map(len, self.ids))
        self.cache: dict[str, int] = {}

    def _crossed(self, a: int, b: int, but: int = -1) -> bool:
        """Would a pair across the border of tokens a and b be merged? ``but``: a rank that does not count."""
        rank = self.rank
        for x, end_x in self.right[a]:
            for y, end_y in self.left[b]:
                r = rank.get(x << 20 | y)
                if r is not None and r < end_x and r <= end_y and r != but:
                    return True
        return False

    def _whole(self, t: int) -> bool:
        """Does encoding the token's bytes give the token itself?"""
        todo = [t]
        while todo:
            if (p := self.parts.get(todo.pop())) is None:
                continue
            if self._crossed(p[0], p[1], p[2]):
                return False
            todo += p[:2]
        return True

    def table(self, piece: bytes) -> list[int]:
        """counts[i]: tokens of piece[:i], for every i."""
        n = len(piece)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        get, known, longest = self.ids.get, self.known, self.longest
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = get(piece[j:i])
                if t is None or (j and last[j] < 0):
                    continue
                if j:
                    key = last[j] << 20 | t
                    ok = known.get(key)
                    if ok is None:
                        if len(known) > 2_000_000:
                            known.clear()
                        ok = known[key] = not self._crossed(last[j], t)
                    if not ok:
                        continue
                count[i], last[i] = count[j] + 1, t
                break
        return count

    def _split_specials(self, text: str) -> tuple[list[str], int]:
        segments, found = [text], 0
        for s in self.specials:
            if s in text:
                segments = [y for x in segments for y in x.split(s)]
                found = len(segments) - 1
        return segments, found

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        cache, find = self.cache, self.pattern.findall
        if len(cache) > CACHE_PIECES:
            cache.clear()
        out = []
        for text in texts:
            total = 0
            if text:
                segments, total = self._split_specials(text)
                for s in segments:
                    pieces = find(s)
                    try:
                        total += sum([cache[p] for p in pieces])
                    except KeyError:
                        for p in [p for p in set(pieces) if p not in cache]:
                            cache[p] = self.table(p.encode("utf-8", "surrogatepass"))[-1]
                        total += sum([cache[p] for p in pieces])
            out.append(total)
        return out

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """counts[i]: exact tokens of text[:i] for every number of characters i, as if that prefix were encoded alone."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int64)
        base = at = 0
        segments, _ = self._split_specials(text)
        for k, s in enumerate(segments):
            if k:  # a special token lies between; inside it its characters are ordinary text
                mark = next(x for x in self.specials if text.startswith(x, at))
                whole = segments[k - 1]
                tail = self._plain(whole + mark) if len(mark) > 1 else None
                start = at - len(whole)
                if tail is not None:
                    out[at : at + len(mark)] = out[start] + tail[len(whole) : len(whole) + len(mark)]
                base = out[start] + self._plain(whole)[-1] + 1
                at += len(mark)
                out[at] = base
            counts = self._plain(s)
            out[at : at + len(s) + 1] = base + counts
            at += len(s)
        return out

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        base = 0
        for m in self.pattern.finditer(text):
            a, b = m.span()
            piece = m[0]
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
            counts = np.array(self.table(piece.encode("utf-8", "surrogatepass")))
            out[a + 1 : b + 1] = base + counts[ends]
            if piece in ("'re", "'ve", "'ll"):  # cut after its first letter it is a mark and a word
                out[a + 2] = base + 2
            base += int(counts[-1])
        # at the end of a prefix a run of white space is one piece, however the text goes on
        for m in _RUNS.finditer(text):
            a, b = m.span()
            if b - a > 1:
                run = m[0]
                ends = np.cumsum([len(c.encode()) for c in run])
                out[a + 1 : b + 1] = out[a] + np.array(self.table(run.encode()))[ends]
        return out

    def fits(self, text: str | None, budget: int) -> int:
        """The longest prefix, in characters, that has at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return int(np.flatnonzero(counts <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None, pattern: str = public_tokenizers.PATTERN, prefix: bool = False) -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean[, fits_chars long]) for every row, whole texts.

    ``fits_chars`` (with ``prefix``) is the longest prefix within ``limit`` tokens. Null and empty texts have 0 bytes
    and 0 tokens; a text of exactly ``limit`` tokens is not over it. Rows are kept one for one, null and repeated ids too;
    an empty table gives an empty one; other columns are not read.
    """
    path = path or public_tokenizers.path(MODEL_FILE)

    def run(keys, texts):
        c = counter(path, pattern)
        n = c.count_batch(texts)
        out = {id_col: keys, "n_bytes": [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}
        return out | ({"fits_chars": [len(x or "") if k <= limit else c.fits(x, limit) for x, k in zip(texts, n, strict=True)]} if prefix else {})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", fits_chars long" * prefix)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
