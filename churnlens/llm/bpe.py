"""Byte-pair merges: rank tables and the segment-tree encoder.

The tokenizer files are read as data (vocabulary and ranked merges); the
merging is done here.
"""

from __future__ import annotations

import functools
import json

import numpy as np

NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


class IntTable:
    """An immutable hash table from pairs of small integers to integers,
    looked up for whole arrays (open addressing)."""

    def __init__(self, a, b, values, missing: int):
        keys = (np.asarray(a, np.uint64) << np.uint64(32)) | np.asarray(b, np.uint64)
        bits = max(4, (max(len(keys), 1) * 4).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, missing, np.int32)
        todo, at = np.arange(len(keys)), ((keys * _MIX) >> self.shift).astype(np.int64)
        values = np.asarray(values, np.int32)
        while len(todo):
            free = self.keys[at] == _EMPTY
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + ~free[left]) & self.mask

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((key * _MIX) >> self.shift).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], self.missing)
        more = np.flatnonzero((seen != key) & (seen != _EMPTY))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            seen = self.keys[at[more]]
            hit = seen == key[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (seen != _EMPTY)]
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes are themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        #: ids of a piece's last byte, where word ends have symbols of their own
        self.last_ids = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = IntTable(self.left, self.right, np.arange(len(pairs)), int(NO_RANK))
        self.rank_of = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(self.left, self.right))}

    # -- encoding ---------------------------------------------------------------

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of ids of each.
        Special strings are single ids."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, counts, ids
        fixed = [i for i, p in enumerate(pieces) if p in self.special] if self.special else []
        if fixed:
            found.append((np.array(fixed), np.ones(len(fixed), np.int64),
                          np.array([self.special[pieces[i]] for i in fixed])))
            size[fixed] = 0
        width = 1
        while width <= SHORT:
            own = np.flatnonzero((size > width // 2) & (size <= width))
            rows = max(256, (1 << 17) // width)
            for k in range(0, len(own), rows):
                at = own[k:k + rows]
                found.append((at, *self._encode_short([raw[i] for i in at], size[at], width)))
            width *= 2
        for i in np.flatnonzero(size > SHORT):
            ids = SegmentTree(self, raw[i]).encode()
            found.append((np.array([i]), np.array([len(ids)]), np.array(ids)))
        counts = np.zeros(len(pieces), np.int64)
        for at, n, _ in found:
            counts[at] = n
        start = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for at, n, ids in found:
            ends = np.cumsum(n)
            out[np.arange(len(ids)) + np.repeat(start[at] - (ends - n), n)] = ids
        return out, counts

    def symbols(self, raw: bytes) -> np.ndarray:
        s = self.byte_ids[np.frombuffer(raw, np.uint8)]
        s[-1] = self.last_ids[raw[-1]]
        return s

    def _encode_short(self, raw: list[bytes], size: np.ndarray, width: int):
        """Segment trees of many pieces of at most ``width`` bytes (a power of
        two) at once: each row of ``tree`` is one piece's tree, and every step
        applies the merge at each row's root."""
        n_rows = len(raw)
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n_rows, width)
        rows = np.arange(n_rows)
        place = np.arange(width)
        alive = place < size[:, None]
        sym = self.byte_ids[data]
        sym[rows, size - 1] = self.last_ids[data[rows, size - 1]]
        if width > 1:
            bits = width.bit_length() - 1
            tree = np.full((n_rows, 2 * width), NO_RANK, np.int32)
            ranks = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n_rows, width - 1)
            leaf = np.where((ranks < NO_RANK) & alive[:, 1:], ranks * width + place[:-1], NO_RANK)
            tree[:, width:2 * width - 1] = leaf  # key: rank, then place
            level = width // 2
            while level:
                tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2],
                                                      tree[:, 2 * level + 1:4 * level:2])
                level //= 2
            nxt = np.tile(place + 1, (n_rows, 1))
            nxt[rows, size - 1] = width
            prv = np.tile(place - 1, (n_rows, 1))
            tree, flat, nxt, prv, keep = tree.ravel(), sym.ravel(), nxt.ravel(), prv.ravel(), alive.ravel()
            act = np.flatnonzero(tree[1::2 * width] < NO_RANK)
            while len(act):
                t0, s0 = act * (2 * width), act * width
                root = tree[t0 + 1]
                at = (root & (width - 1)).astype(np.int64)
                new = self.merged[root >> bits]
                gone = nxt[s0 + at]
                after = nxt[s0 + gone]
                before = prv[s0 + at]
                flat[s0 + at] = new
                keep[s0 + gone] = False
                nxt[s0 + at] = after
                inner, outer = after < width, before >= 0
                prv[(s0 + after)[inner]] = at[inner]
                tree[t0 + width + gone] = NO_RANK
                right = np.full(len(act), NO_RANK, np.int32)
                r = self.rank(new[inner], flat[(s0 + after)[inner]])
                right[inner] = np.where(r < NO_RANK, r * width + at[inner], NO_RANK)
                tree[t0 + width + at] = right
                r = self.rank(flat[(s0 + before)[outer]], new[outer])
                tree[(t0 + width + before)[outer]] = np.where(r < NO_RANK, r * width + before[outer], NO_RANK)
                touched = [gone + width, at + width, np.where(outer, before, at) + width]
                for _ in range(bits):
                    for j in range(3):
                        touched[j] = node = touched[j] >> 1
                        below = t0 + 2 * node
                        tree[t0 + node] = np.minimum(tree[below], tree[below + 1])
                act = act[tree[t0 + 1] < NO_RANK]
            sym, alive = flat.reshape(n_rows, width), keep.reshape(n_rows, width)
        return alive.sum(axis=1), sym[alive]

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids) -> str:
        """Text of ids as the library decodes a file without a decoder: the
        tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


#: Pieces of more bytes get a tree of their own.
SHORT = 64


class SegmentTree:
    """The merge order of one piece: leaf i holds (rank, i) of the pair that
    starts at symbol i, a node the least key below it.  The root is the
    leftmost pair of the lowest rank."""

    def __init__(self, merges: Merges, raw: bytes):
        self.m = merges
        self.sym = merges.symbols(raw).tolist()
        n = len(self.sym)
        self.size = 1 << max(n - 1, 0).bit_length()
        self.next, self.prev = list(range(1, n + 1)), list(range(-1, n - 1))
        self.none = (int(NO_RANK), 0)
        self.tree = [self.none] * (2 * self.size)
        for i in range(n - 1):
            self.tree[self.size + i] = self._key(i)
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = min(self.tree[2 * node], self.tree[2 * node + 1])

    def _key(self, i: int):
        j = self.next[i]
        if j >= len(self.sym):
            return self.none
        r = self.m.rank_of.get((self.sym[i], self.sym[j]))
        return self.none if r is None else (r, i)

    def _update(self, i: int, key) -> None:
        node, tree = self.size + i, self.tree
        tree[node] = key
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    def encode(self) -> list[int]:
        n = len(self.sym)
        if n == 1:
            return self.sym
        while self.tree[1] != self.none:
            rank, i = self.tree[1]
            j = self.next[i]
            self.sym[i] = int(self.m.merged[rank])
            self.next[i] = k = self.next[j]
            if k < n:
                self.prev[k] = i
            self._update(j, self.none)
            self._update(i, self._key(i))
            if self.prev[i] >= 0:
                self._update(self.prev[i], self._key(self.prev[i]))
        out, i = [], 0
        while i < n:
            out.append(self.sym[i])
            i = self.next[i]
        return out


@functools.lru_cache(4)
def load_merges(path: str) -> Merges:
    return Merges(path)
