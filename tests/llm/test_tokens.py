import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnlens.llm import counts, encoding, packing, tokens, wavelet
from churnlens.llm.bpe import SegmentTree, load_merges
from churnlens.llm.common import slabs

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


def odd_texts(n=300):
    rng = random.Random(3)
    some = list("a'brelv  \n\t.!1é漢<|>Σİ́\x1c\x85\xa0 \U0001f600\U00010940") + \
        ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", " the", "  ", " word,", " ok."]
    return ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(n)] + \
        ["", " ", "a" * 500, "ab" * 400 + " " * 70 + "-" * 200, "é" * 90]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def split_ids(flat, n):
    at = np.concatenate([[0], np.cumsum(n)])
    return [flat[i:j].tolist() for i, j in zip(at, at[1:])]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_segment_tree_encoding_is_the_librarys(path):
    texts = odd_texts()
    assert split_ids(*encoding.Encoder(path).encode(texts)) == library(path, texts)


def test_one_tree_and_many_trees_agree():
    m = load_merges(BYTE)
    pieces = [" " + w for w in ("straight", "forward", "aaaaaaaaaa", "x")]
    flat, n = m.encode_pieces(pieces)
    assert split_ids(flat, n) == [SegmentTree(m, p.encode()).encode() for p in pieces]


def test_decoding_is_the_librarys():
    tk, enc = Tokenizer.from_file(WORD), encoding.Encoder(WORD)
    for ids in library(WORD, odd_texts(50)):
        assert enc.decode(ids) == tk.decode(ids, skip_special_tokens=False)


def test_library_encoder_by_words_equals_whole_texts():
    texts = odd_texts()
    assert split_ids(*tokens.LibraryEncoder(BYTE).encode(texts)) == library(BYTE, texts)


def test_piece_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 3)
    enc = tokens.LibraryEncoder(BYTE)
    for text in odd_texts(20):
        assert enc.encode([text])[0].tolist() == library(BYTE, [text])[0]


def test_word_table_encodes_the_parts_of_a_line_break_once(monkeypatch):
    rng = random.Random(7)
    ends = ["", ".", ",", "\n", "!!", "é", "'s", " 1", "\n\n", "漢", "ʰ"]
    half = [w + e for w in ("and", "Éte", "x", "слово") for e in ends]
    texts = ["\n".join(rng.choices(half, k=rng.randint(1, 3))) + " " + " ".join(
        a + "\n" + b for a, b in zip(rng.choices(half, k=9), rng.choices(half, k=9))) for _ in range(300)]
    enc = tokens.LibraryEncoder(BYTE)
    assert split_ids(*enc.encode(texts)) == library(BYTE, texts)
    asked, compute = [], enc.words.compute
    enc.words.compute = lambda parts: (asked.extend(parts.to_pylist()), compute(parts))[1]
    assert split_ids(*enc.encode(["a onea.\nTwo, onea! twob.\nTwo onea"])) == library(BYTE, ["a onea.\nTwo, onea! twob.\nTwo onea"])
    assert sorted(asked) == ["\nTwo", " a", " onea", " twob"]
    monkeypatch.setattr(tokens, "MAX_WORDS", 3)
    for i in range(0, 40, 2):
        assert split_ids(*enc.encode(texts[i:i + 2])) == library(BYTE, texts[i:i + 2])
    assert len(enc.words.words) == len(enc.words.length) < 300 and enc.encode([])[0].size == 0


def test_slabs_keep_the_text_and_its_pieces():
    text = " ".join(odd_texts(200))
    parts = list(slabs(text, 100))
    assert "".join(parts) == text and len(parts) > 3
    split = tokens.splitter(tokens.BYTE_PATTERN)
    assert [p for s in parts for p in split(s)] == split(text)


def test_prefix_counts_by_brute_force():
    tk, c = Tokenizer.from_file(BYTE), counts.PrefixCounter(BYTE)
    for text in odd_texts(60)[:-4]:
        want = [len(tk.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        got = c.prefix_counts(text)
        assert got.tolist() == want
        budget = max(want) // 2
        assert want[counts.longest_prefix(got, budget)] <= budget
        assert all(w > budget for w in want[counts.longest_prefix(got, budget) + 1:])
    assert c.totals(odd_texts()).tolist() == [len(x) for x in library(BYTE, odd_texts())]


def by_row(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_encode_documents_edge_cases(edge, nothing):
    got = by_row(encoding.encode_documents(edge, ["doc_id"]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    tk, want = Tokenizer.from_file(WORD), []
    for r in edge.collect():
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        text = tk.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encoding.encode_documents(nothing, ["doc_id"]).count() == 0


def test_count_tokens_edge_cases(edge, nothing):
    got = by_row(counts.count_tokens(edge, ["doc_id"]), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = [len(x) for x in library(BYTE, [r.text or "" for r in edge.collect()])]
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), k, k > 1024)
                          for r, k in zip(edge.collect(), n)), key=repr)
    assert counts.count_tokens(nothing, ["doc_id"]).count() == 0
    cut = counts.truncate(edge, 5, ["doc_id"]).collect()
    assert all(len(x) <= 5 for x in library(BYTE, [r.text for r in cut]))


def test_best_fit_decreasing_takes_the_tightest_room():
    sequences, offsets = packing.best_fit_decreasing([7, 6, 3, 2, 1, 1], window=10)
    assert sequences == [0, 1, 0, 1, 1, 1] and offsets == [0, 0, 7, 6, 8, 9]
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 10) for _ in range(300)), reverse=True)
    free, want = [], []
    for n in lengths:  # plain search for the least room that fits
        fits = [r for r in free if r >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(10 - n)
        want.append(sorted(free))
    got, _ = packing.best_fit_decreasing(lengths, window=10)
    fill = {}
    for s, n in zip(got, lengths):
        fill[s] = fill.get(s, 0) + n
    assert sorted(10 - f for f in fill.values()) == want[-1]


def test_packing_edge_cases(edge, nothing):
    out = packing.pack_documents(edge, window=64, shard_pieces=40, keep_ids=True).collect()
    docs = {}
    for r in edge.collect():
        docs.setdefault(r.doc_id, []).append(library(BYTE, [r.text or ""])[0] + [1])
    sequences = {}
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert any(d[r.start:r.start + r.length] == ids and len(d) == r.doc_tokens for d in docs[r.doc_id])
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(d) for ds in docs.values() for d in ds)
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (700, 1), (3000, 9), (5000, 4000)])
def test_wavelet_matrix_by_brute_force(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    f = wavelet.ShardFile.from_bytes(wavelet.ShardFile.build([1, None], [n, 0], x).to_bytes())
    m = f.matrix
    assert m.values().tolist() == x.tolist() and f.keys == [1, None] and f.lengths.tolist() == [n, 0]
    assert m.count(top + 5) == 0
    for i in range(0, n, max(1, n // 23)):
        v = int(x[i])
        places = np.flatnonzero(x == v)
        assert m.access(i) == v and m.rank(v, i) == int((places < i).sum())
        assert m.count(v, i // 2, i) == int(((places >= i // 2) & (places < i)).sum())
        assert m.select(v, int((places < i).sum())) == i
        assert np.array_equal(m.places(v), places)
    with pytest.raises(IndexError):
        m.access(n)


def test_token_files_edge_cases(edge, nothing):
    files = wavelet.write_token_files(edge, shard_tokens=50, partitions=3)
    got = sorted(wavelet.read_token_files(files).collect(), key=lambda r: r.start)
    docs = sorted(((r.doc_id is not None, r.doc_id), library(BYTE, [r.text or ""])[0] + [2]) for r in edge.collect())
    assert [r.doc_id for r in got] == [d[0][1] for d in docs]
    at = 0
    for r in got:
        same = [d for (_, k), d in docs if k == r.doc_id]
        assert r.start == at and r.n_tokens in map(len, same)
        assert r.ids_crc32 in [zlib.crc32(np.array(d, "<u4").tobytes()) for d in same]
        at += r.n_tokens
    assert at == sum(len(d) for _, d in docs)
    assert wavelet.read_token_files(wavelet.write_token_files(nothing)).count() == 0


def test_token_files_answer_without_decoding(spark, edge, nothing):
    files = wavelet.write_token_files(edge, shard_tokens=50, partitions=3)
    docs = [(r.doc_id, library(BYTE, [r.text or ""])[0] + [2]) for r in edge.collect()]
    flat = [i for _, ids in docs for i in ids]
    ask = [2, 2, flat[0], flat[len(flat) // 2], 50_001, 1 << 40]
    assert {r.id: r.n for r in wavelet.count_ids(files, ask).collect()} == {i: flat.count(i) for i in ask}

    found = wavelet.find_ids(files, ask).collect()
    order = {(r.doc_id, r.start): r.n_tokens for r in wavelet.read_token_files(files).collect()}
    assert len(found) == sum(flat.count(i) for i in set(ask))
    assert len({(r.id, r.place) for r in found}) == len(found)
    assert all(r.offset < order[(r.doc_id, r.place - r.offset)] for r in found)

    n = len(flat)
    whole = sorted(wavelet.read_ranges(files, [(0, n)]).collect(), key=lambda r: r.place)
    stored = [i for r in whole for i in r.ids]
    assert sorted(stored) == sorted(flat) and [r.place for r in whole][0] == 0
    assert all(stored[r.place] == r.id for r in found)
    parts = wavelet.read_ranges(files, [(3, 9), (40, 200), (7, 7), (n - 2, n + 50), (n + 1, n + 9)]).collect()
    for r in parts:
        assert r.ids == stored[r.place:r.place + len(r.ids)] and r.begin <= r.place
    assert {(r.begin, r.end): sum(len(x.ids) for x in parts if x.begin == r.begin) for r in parts} == {
        (3, 9): 6, (40, 200): 160, (n - 2, n + 50): 2}

    none = wavelet.write_token_files(nothing)
    assert [(r.id, r.n) for r in wavelet.count_ids(none, [2]).collect()] == [(2, 0)]
    assert wavelet.find_ids(none, [2]).count() == wavelet.read_ranges(none, [(0, 5)]).count() == 0
    assert wavelet.count_ids(files, []).count() == wavelet.find_ids(files, []).count() == 0


def test_copies_of_one_row_are_split(spark):
    files = wavelet.write_token_files(spark.range(3000).selectExpr("7L AS doc_id", "'one and the same' AS text"),
                                      shard_tokens=50, partitions=4)
    assert files.select("part").distinct().count() == 4
    got = wavelet.read_token_files(files).collect()
    assert len(got) == 3000 and sorted(r.start for r in got) == [i * got[0].n_tokens for i in range(3000)]
