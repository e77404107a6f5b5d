"""Tokenizer files and piece tables.

A tokenizer's text pattern cuts a text into pieces that are encoded on
their own, so a task encodes each distinct piece once and looks the rest
up.  The table is bounded: past ``MAX_PIECES`` it starts anew.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from churnlens.llm.bpe import byte_letters
from churnlens.llm.common import slabs

MAX_PIECES = 400_000

#: Text patterns (fixed values of the two tokenizers), with general Unicode classes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)


def _plain_form(pattern: str) -> str:
    """The pattern for Python's faster ``re`` (right for texts without the
    characters of ``_odd``)."""
    return (pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"[\p{L}]", r"[^\W\d_]")
            .replace(r"[\p{N}]", r"\d").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))


@functools.lru_cache(None)
def _odd() -> re.Pattern:
    """Characters that ``re`` puts in another class than Unicode does, and
    all beyond 16 bits (a small class is searched fast)."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(a, every)) ^ set(re.findall(b, every))
    return re.compile("[" + "".join(map(re.escape, sorted(odd))) + "\U00010000-\U0010ffff]")


@functools.lru_cache(None)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the pieces of a text."""
    exact = regex.compile(pattern).findall
    plain = re.compile(_plain_form(pattern)).findall

    def split(text: str) -> list[str]:
        if text.isascii() and not _CONTROL.search(text) or not _odd().search(text):
            return plain(text)
        return exact(text)

    return split


_CONTROL = re.compile("[\x1c-\x1f]")


class _Numbers(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceTable:
    """Values (arrays of numbers) of pieces: ``compute`` gets a list of new
    pieces and returns (all values one after another, values per piece)."""

    def __init__(self, split, compute, dtype=np.uint16):
        self.split, self.compute, self.dtype = split, compute, dtype
        self._reset()

    def _reset(self):
        self.index = _Numbers()
        self.pool = np.zeros(0, self.dtype)
        self.length = np.zeros(0, np.int64)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all pieces and the number of pieces of each text."""
        if len(self.index) > MAX_PIECES:
            self._reset()
        out, counts = [], []
        for text in texts:
            n = 0
            for part in slabs(text):
                pieces = self.split(part)
                n += len(pieces)
                out.extend(map(self.index.__getitem__, pieces))
            counts.append(n)
        self._fill()
        return np.array(out, np.int64), np.array(counts, np.int64)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """Table rows of pieces."""
        if len(self.index) > MAX_PIECES:
            self._reset()
        rows = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self._fill()
        return rows

    def _fill(self) -> None:
        if self.index.new:
            values, lengths = self.compute(self.index.new)
            self.index.new = []
            self.length = np.concatenate([self.length, lengths])
            self.pool = np.concatenate([self.pool, np.asarray(values, self.dtype)])

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All values of the texts and the number of values of each text."""
        rows, counts = self.rows(texts)
        return gather(self.pool, self.length, rows, counts)


#: Marks that often end a word.
MARKS = ".,;:!?"
#: Words that the library is given in one string.
JOINED = 64
#: Words that an encoder keeps.
MAX_WORDS = 1_000_000
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters in every version of Unicode's tables (Latin, Greek, Cyrillic, kana, Han, Hangul).
_LETTERS = (r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3a9}\x{3b1}-\x{3c9}"
            r"\x{400}-\x{481}\x{48a}-\x{52f}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]+")


class WordTable:
    """Values (arrays of numbers) of words in Arrow arrays: ``compute`` gets an
    array of new words and returns (all values one after another, values per
    word).  Past ``MAX_WORDS`` only the words of the last question stay."""

    def __init__(self, compute, dtype=np.uint16):
        self.compute = compute
        self.words = pa.array([], pa.string())
        self.pool, self.length = np.zeros(0, dtype), np.zeros(0, np.int64)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Table rows of words (repeated ones may be among them)."""
        coded = words.dictionary_encode()
        asked, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if len(self.words) > MAX_WORDS:
            self._keep(np.flatnonzero(self._held(asked) >= 0))
        # the table's words are looked up among those asked for, which are fewer
        held = self._held(asked)
        known = np.flatnonzero(held >= 0)
        row = np.full(len(asked), -1, np.int64)
        row[held[known]] = known
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.words) + np.arange(len(new))
            words = asked.take(pa.array(new))
            values, lengths = self.compute(words)
            self.words = pa.concat_arrays([self.words, words])
            self.length = np.concatenate([self.length, lengths])
            self.pool = np.concatenate([self.pool, np.asarray(values, self.pool.dtype)])
        return row[place]

    def _held(self, asked: pa.Array) -> np.ndarray:
        """Place of each word of the table in ``asked``, or -1."""
        return pc.index_in(self.words, value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False)

    def _keep(self, rows: np.ndarray) -> None:
        self.pool, _ = gather(self.pool, self.length, rows, np.ones(len(rows), np.int64))
        self.words, self.length = self.words.take(pa.array(rows)), self.length[rows]


class LibraryEncoder:
    """Token ids by the ``tokenizers`` library with its defaults
    (add_special_tokens=False) for a byte-level file; special strings in a
    text become their ids.

    The pattern always begins a piece at a single space between two other
    characters, so texts are cut there and the library encodes each distinct
    word of a slice of texts once, many of them in one string; the bytes
    that each token stands for tell where a word's ids end.  Texts with a
    space next to more white space or with a special string go to the
    library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"^{_WHITE}", f"{_WHITE}$", f" {_WHITE}", f"{_WHITE} ", *special])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token)  # a letter a byte
        self.words = WordTable(self._part_ids)
        ids, lengths = self._ids(list(MARKS))
        if lengths.tolist() != [1] * len(MARKS):
            raise ValueError("a mark of this tokenizer has several ids")
        self.marks, self.mark_ids = pa.array(list(MARKS)), ids
        self.marked = f"^[ \\n]{_LETTERS}[{MARKS}]$"
        self.pair = f"^{_LETTERS}[{MARKS}]?\\n{_LETTERS}[{MARKS}]?$"

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(lengths.sum())), lengths

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each of which begins with a space or a line break."""
        broken = pc.starts_with(parts, "\n")
        kinds = [self._joined_ids(parts.filter(kind)) for kind in (pc.invert(broken), broken)]
        rows = np.empty(len(parts), np.int64)
        at = broken.to_numpy(zero_copy_only=False)
        rows[np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)])] = np.arange(len(parts))
        return gather(*(np.concatenate(both) for both in zip(*kinds)), rows, np.ones(len(rows), np.int64))

    def _joined_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that all begin with the same character, where the
        pattern begins a piece."""
        texts = parts.to_pylist()
        flat, _ = self._ids(["".join(texts[i:i + JOINED]) for i in range(0, len(texts), JOINED)])
        ends = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
        after = np.cumsum(self.token_bytes[flat])
        last = np.searchsorted(after, ends)
        if texts and not np.array_equal(after[np.minimum(last, len(after) - 1)], ends):
            return self._ids(texts)  # a token across two parts
        return flat, np.diff(np.concatenate([[-1], last]))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the number of ids of each text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(~whole & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        lists = pc.split_pattern(texts.take(pa.array(cut)), " ")
        words = lists.flatten().dictionary_encode()
        known = words.dictionary
        rows = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[cut] = lists.value_lengths().to_numpy(zero_copy_only=False)
        # a text's first word has no space before it, and a whole text is a word of its own
        first = (np.cumsum(counts) - counts)[cut]
        alone = known.take(pa.array(rows[first])).to_pylist() + texts.filter(pa.array(whole)).to_pylist()
        ids, lengths = self._known_ids(known)
        more, more_lengths = self._ids(alone)
        rows[first] = len(known) + np.arange(len(cut))
        at_whole = np.flatnonzero(whole)
        rows = np.insert(rows, np.cumsum(counts)[at_whole], len(known) + len(cut) + np.arange(len(at_whole)))
        counts[at_whole] = 1
        return gather(np.concatenate([ids, more]), np.concatenate([lengths, more_lengths]), rows, counts)

    def _known_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each after a space.  The pattern begins a
        piece at a line break between a word and a letter, so such a word is
        two parts; a mark after the letters of a part is a piece of its own,
        so its id is added to the part's ids."""
        pair = pc.match_substring_regex(words, self.pair)
        at = np.flatnonzero(pair.to_numpy(zero_copy_only=False))
        halves = pc.split_pattern(words.filter(pair), "\n").flatten()
        lead = pc.replace_with_mask(words, pair, halves.take(pa.array(np.arange(len(at)) * 2)))
        rest = halves.take(pa.array(np.arange(len(at)) * 2 + 1))
        parts = pa.concat_arrays([pc.binary_join_element_wise(" ", lead, ""), pc.binary_join_element_wise("\n", rest, "")])
        marked = pc.match_substring_regex(parts, self.marked)
        ends, own = np.flatnonzero(marked.to_numpy(zero_copy_only=False)), parts.filter(marked)
        rows = self.words.rows(pc.replace_with_mask(parts, marked, pc.utf8_slice_codeunits(own, 0, -1)))
        tails = np.full(len(parts), -1, np.int64)  # the marks' ids come after the table's
        tails[ends] = len(self.words.length) + pc.index_in(
            pc.utf8_slice_codeunits(own, -1), value_set=self.marks).to_numpy(zero_copy_only=False)
        # word, its mark, what follows the line break, its mark; -1: none
        grid = np.full((len(words), 4), -1, np.int64)
        grid[:, 0], grid[:, 1] = rows[:len(words)], tails[:len(words)]
        grid[at, 2], grid[at, 3] = rows[len(words):], tails[len(words):]
        return gather(np.concatenate([self.words.pool, self.mark_ids]),
                      np.concatenate([self.words.length, np.ones(len(self.marks), np.int64)]),
                      grid[grid >= 0], (grid >= 0).sum(axis=1))


def gather(pool: np.ndarray, lengths: np.ndarray, rows: np.ndarray, counts: np.ndarray):
    """The values of table rows one after another, and the number of values
    of each group of ``counts`` rows; row r holds ``lengths[r]`` values of
    the pool, after those of the rows before it."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[rows]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[rows] - (ends - n), n)
    before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return pool[at], np.diff(before)


@functools.lru_cache(None)
def _unassigned() -> re.Pattern:
    """16-bit characters that this Python's Unicode tables do not know, and
    all beyond 16 bits."""
    new = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
    return re.compile("[" + "".join(map(re.escape, new)) + "\U00010000-\U0010ffff]")


def _too_new(text: str) -> bool:
    return bool(_unassigned().search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


def _library_pieces(path: str):
    """The library's own normaliser and pattern, for the rare text with
    characters newer than this Python's Unicode tables."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in enumerate(byte_letters())}

    def split(text: str) -> list[str]:
        if tokenizer.normalizer is not None:
            text = tokenizer.normalizer.normalize_str(text)
        found = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(byte_of[c] for c in piece).decode() for piece, _ in found]

    return split


def library_for_new(path: str, split):
    """``split``, but by the library for texts with characters newer than
    this Python's Unicode tables."""
    newer = functools.cache(lambda: _library_pieces(path))

    def run(text: str) -> list[str]:
        if not text.isascii() and _too_new(text):
            return newer()(text)
        return split(text)

    return run


def with_special(split, special: list[str]):
    """Cut special strings out of a text before the pattern sees it."""
    if not special:
        return split
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def run(text: str) -> list[str]:
        if not cut.search(text):
            return split(text)
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out.extend([part] if i % 2 else split(part))
        return out

    return run


@functools.lru_cache(4)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process."""
    return LibraryEncoder(path)
