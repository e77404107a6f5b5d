"""Exact token counts at every prefix by dynamic programming.

The encoding of a prefix of a piece ends with some token; without it, it is
the encoding of a shorter prefix.  A token can end a prefix if it is a
suffix of it and its pair with the shorter prefix's last token is one that
merging leaves as it is.  Exactly one token passes, so going over the ends
of a piece from left to right gives last token and count at every prefix,
and a text's counts are sums over its pieces.

Whether merging leaves a pair alone is decided on the two tokens' borders:
the symbols at the border are undone from the latest merge on, and no pair
of symbols that meet there may have a merge that comes earlier than both of
the merges that take them into their tokens.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm.bpe import NO_RANK, IntTable, Merges, byte_letters, load_merges
from churnlens.llm.common import map_texts, table
from churnlens.llm.tokens import BYTE_PATTERN, PieceTable, library_for_new, splitter, tokenizer_path, with_special

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Pieces of more bytes are counted one at a time.
SHORT = 32


class PrefixCounter:
    """Token counts of all prefixes for a byte-level BPE file without word
    ends, as the ``tokenizers`` library encodes them by default."""

    def __init__(self, path: str):
        m: Merges = load_merges(path)
        if m.suffix:
            raise ValueError("prefix counts need a file without word-end symbols")
        self.merges = m
        n = len(m.tokens)
        self.formed = np.full(n, -1, np.int32)  # rank of the merge that makes a token
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        _, first = np.unique(m.merged, return_index=True)
        self.formed[m.merged[first]] = first
        self.left[m.merged[first]], self.right[m.merged[first]] = m.left[first], m.right[first]
        self._build_trie(byte_letters())
        self.special = list(m.special)
        self.split = library_for_new(path, splitter(BYTE_PATTERN))
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.table = PieceTable(with_special(self.split, self.special), self._totals, np.uint32)

    def _build_trie(self, letters: list[str]) -> None:
        byte_of = {c: b for b, c in enumerate(letters)}
        special = set(self.merges.special)
        self.token_of = {bytes(byte_of[c] for c in t): i for i, t in enumerate(self.merges.tokens)
                         if t and t not in special}
        self.longest = max(map(len, self.token_of))
        nodes, ends = {}, [-1]
        for token, i in self.token_of.items():
            at = 0
            for b in token:
                nxt = nodes.get((at, b))
                if nxt is None:
                    nodes[(at, b)] = nxt = len(ends)
                    ends.append(-1)
                at = nxt
            ends[at] = i
        keys = np.array(list(nodes), np.int64).reshape(-1, 2)
        self.child = IntTable(keys[:, 0], keys[:, 1], np.array(list(nodes.values()), np.int64), -1)
        self.ends = np.array(ends, np.int32)

    # -- pairs of tokens that merging leaves alone ----------------------------------

    def pairs_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of tokens: whether ``a`` before ``b`` stays two tokens."""
        ok = np.ones(len(a), bool)
        x, y = a.astype(np.int32), b.astype(np.int32)
        lim_x, lim_y = np.full(len(a), NO_RANK), np.full(len(a), NO_RANK)
        at = np.arange(len(a))
        while len(at):
            r = self.merges.rank(x, y)
            # of equal merges the left one comes first
            clash = (r < lim_x) & (r <= lim_y) & (r < NO_RANK)
            ok[at[clash]] = False
            fx, fy = self.formed[x], self.formed[y]
            go = ~clash & ((fx >= 0) | (fy >= 0))
            at, x, y, lim_x, lim_y, fx, fy = (v[go] for v in (at, x, y, lim_x, lim_y, fx, fy))
            undo_x = fx > fy
            lim_x, lim_y = np.where(undo_x, fx, lim_x), np.where(undo_x, lim_y, fy)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def _pair_stays(self, a: int, b: int) -> bool:
        known = self.pair_memo.get((a, b))
        if known is None:
            if len(self.pair_memo) > 500_000:
                self.pair_memo.clear()
            known = bool(self.pairs_stay(np.array([a]), np.array([b]))[0])
            self.pair_memo[(a, b)] = known
        return known

    # -- counts within pieces ----------------------------------------------------

    def _prefix_counts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every byte end of all pieces one after another, and the
        number of bytes of each piece (a special string: one entry)."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        special = np.array([p in self.merges.special for p in pieces], bool)
        size[special] = 1
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        out[start[special]] = 1
        todo = ~special
        for width in (4, 8, 12, 16, 24, SHORT):
            own = np.flatnonzero(todo & (size <= width))
            todo[own] = False
            rows = max(256, (1 << 19) // (width * width))
            for k in range(0, len(own), rows):
                at = own[k:k + rows]
                counts = self._short([raw[i] for i in at], size[at], width)
                inside = np.arange(width) < size[at][:, None]
                out[(start[at][:, None] + np.arange(width))[inside]] = counts[inside]
        for i in np.flatnonzero(todo):
            out[start[i]:start[i] + size[i]] = self._long(raw[i])
        return out, size

    def _short(self, raw: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        n = len(raw)
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width)
        rows = np.arange(n)
        # token[s, e]: the token of bytes s..e, -1 if there is none
        token = np.full((width, width, n), -1, np.int32)
        for s in range(width):
            at = rows[size > s]
            node = np.zeros(len(at), np.int32)
            for e in range(s, width):
                live = size[at] > e
                at, node = at[live], node[live]
                if not len(at):
                    break
                node = self.child(node, data[at, e])
                at, node = at[node >= 0], node[node >= 0]
                token[s, e, at] = self.ends[node]
        last = np.zeros((width + 1, n), np.int32)
        count = np.zeros((width + 1, n), np.int32)
        for e in range(width):
            at = rows[size > e]
            for s in range(e + 1):
                t = token[s, e, at]
                have = np.flatnonzero(t >= 0)
                if not len(have):
                    continue
                if s:
                    have = have[self.pairs_stay(last[s, at[have]], t[have])]
                took = at[have]
                last[e + 1, took] = t[have]
                count[e + 1, took] = count[s, took] + 1
                left = np.ones(len(at), bool)
                left[have] = False
                at = at[left]
                if not len(at):
                    break
        return count[1:].T

    def _long(self, raw: bytes) -> np.ndarray:
        last, count = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        token_of = self.token_of.get
        for e in range(1, len(raw) + 1):
            for s in range(max(0, e - self.longest), e):
                t = token_of(raw[s:e])
                if t is not None and (s == 0 or self._pair_stays(last[s], t)):
                    last[e], count[e] = t, count[s] + 1
                    break
        return np.array(count[1:], np.uint32)

    # -- whole texts ---------------------------------------------------------------

    def totals(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole texts."""
        per_piece, pieces = self.table.values(texts)
        ends = np.concatenate([[0], np.cumsum(per_piece, dtype=np.int64)])
        return np.diff(ends[np.concatenate([[0], np.cumsum(pieces)])])

    def _totals(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The count at each piece's end."""
        counts, size = self._prefix_counts(pieces)
        return counts[np.cumsum(size) - 1], np.ones(len(pieces), np.int64)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of ``text[:i]`` for every i from 0 to its length."""
        out = np.zeros(len(text) + 1, np.int64)
        pieces = self.table.split(text)
        base = at = segment = 0  # tokens and characters before the piece; where its segment began
        run = None  # a run of white space that reaches up to here: (start, tokens before)
        for piece in pieces:
            n = len(piece)
            if piece in self.merges.special:
                # a cut special string is ordinary text, joined to what is before it
                for k in range(1, n):
                    out[at + k] = out[segment] + sum(int(self._counts(p)[-1])
                                                     for p in self.split(text[segment:at + k]))
                base += 1
                at += n
                out[at], segment, run = base, at, None
                continue
            counts = self._counts(piece)
            byte = np.cumsum([len(c.encode("utf-8")) for c in piece])
            out[at + 1:at + n + 1] = base + counts[byte - 1]
            if n == 3 and piece[0] == "'" and piece in ("'re", "'ve", "'ll"):
                out[at + 2] = base + 2  # "'r" is no contraction yet: two pieces
            lead = n - len(_strip(piece))
            if lead:
                # white space at a prefix's end is one piece, from the run's start on
                if run is None:
                    run = (at, base)
                whole = text[run[0]:at + lead]
                got = self._counts(whole)
                ends = np.cumsum([len(c.encode("utf-8")) for c in whole])
                out[run[0] + 1:at + lead + 1] = run[1] + got[ends - 1]
            if lead < n:
                run = None
            base += int(counts[-1])
            at += n
        return out

    def _counts(self, piece: str) -> np.ndarray:
        return self._prefix_counts([piece])[0].astype(np.int64)


def _strip(piece: str) -> str:
    """A piece without the white space at its start."""
    i = 0
    while i < len(piece) and _SPACE.match(piece[i]):
        i += 1
    return piece[i:]


def _space_pattern():
    import regex
    return regex.compile(r"\s")


_SPACE = _space_pattern()


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


@functools.lru_cache(4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, keep: list[str], path: str | None = None, limit: int = LIMIT,
                 with_prefixes: bool = False) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to the ``keep`` columns, with
    ``with_prefixes`` also prefix_tokens (the count at every prefix, from
    which any truncation or budget question is answered).

    Null and empty texts have no bytes and no tokens; repeated rows keep
    their own row; an empty table gives no rows; texts are read whole,
    however long; a kept column named like a new one is replaced; other
    columns are not read.
    """
    path = path or tokenizer_path(TOKENIZER)

    def run(texts):
        c = counter(path)
        n = c.totals(texts)
        out = {"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": pa.array(n),
               "over_limit": pa.array(n > limit)}
        return out | ({"prefix_tokens": [c.prefix_counts(t).tolist() for t in texts]} if with_prefixes else {})

    return map_texts(docs, run, "n_bytes long, n_tokens long, over_limit boolean"
                     + ", prefix_tokens array<long>" * with_prefixes, keep)


def truncate(docs: DataFrame, budget: int, keep: list[str], path: str | None = None) -> DataFrame:
    """Every text's longest prefix of at most ``budget`` tokens, read off the
    prefix counts without encoding again."""
    path = path or tokenizer_path(TOKENIZER)

    def run(texts):
        c = counter(path)
        return {"text": [t[:longest_prefix(c.prefix_counts(t), budget)] for t in texts]}

    return map_texts(docs, run, "text string", keep)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents."""
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
