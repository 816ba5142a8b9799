import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import common, packing, token_store, tokenization, trie_bpe
from tests.llm import tables

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def test_wavelet_matrix_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.empty(0, np.uint32), np.array([5], np.uint32), rng.integers(0, 50_000, 3000).astype(np.uint32), np.full(700, 9, np.uint32)):
        m = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(ids).to_bytes())
        assert np.array_equal(m.decode(), ids)
        for v in {int(x) for x in ids[:5]} | {77}:
            places = np.flatnonzero(ids == v)
            assert m.count(v) == len(places) and list(m.occurrences(v)) == places.tolist()
            if len(places):
                assert m.select(v, len(places) - 1) == places[-1] and m.rank(v, len(ids) // 2) == int((ids[: len(ids) // 2] == v).sum())
        for i in range(0, len(ids), 499):
            assert m.access(i) == ids[i]


def test_store_equals_library(spark):
    docs, t = tables.documents(spark), library(BYTE)
    path = common.new_path(spark, "store")
    token_store.write_shards(docs, path, BYTE, 2)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(tables.texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want, places = 0, [], []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(packed(ids))))
        places += [(d, k) for k, v in enumerate(ids) if v == 383]
        at += len(ids)
    assert got == want
    found = token_store.locate(spark, path, 383).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(places, key=repr)


def test_empty_store(spark):
    path = common.new_path(spark, "store")
    token_store.write_shards(tables.documents(spark, []), path, BYTE, 2)
    assert token_store.read_documents(spark, path).count() == 0


def test_round_trip_equals_library(spark):
    t = library(WORD)
    got = sorted(tuple(r) for r in trie_bpe.encode_and_decode(tables.documents(spark), WORD).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect() if r.doc_id is not None)
    want = []
    for d, text in tables.texts():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(w for w in want if w[0] is not None)
    assert trie_bpe.encode_and_decode(tables.documents(spark, []), WORD).count() == 0


def test_packing_is_gapless_and_whole(spark):
    t = library(WORD)
    rows = [r for r in tables.texts() if r[0] is not None]
    rows = list({d: (d, x) for d, x in rows}.values()) + [(9000 + k, tables.prose(tables.random.Random(k), 3000)) for k in range(12)]
    got = packing.pack_documents(tables.documents(spark, rows), WORD, 2).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in rows:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(packed(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    used = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used += at if at & (at - 1) == 0 else 4096
    assert sum(r.length for r in got) / used > 0.95
    assert packing.pack_documents(tables.documents(spark, []), WORD, 2).count() == 0


@pytest.mark.parametrize("seed", range(15))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    size = 40
    pos = [0, *np.cumsum(rng.integers(1, 20, rng.integers(1, 30))).tolist()]
    penalty = [0, *rng.integers(0, 12, len(pos) - 1).tolist()]
    least = 16

    def waste(w):
        return 0 if w & (w - 1) == 0 and w >= least else size - w

    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            if pos[j] - pos[i] <= size:
                best[j] = min(best[j], best[i] + waste(pos[j] - pos[i]) + (penalty[j]))
    cuts = packing.best_cuts(pos, penalty, size, least)
    at = [0, *[c for c in cuts if c]]
    assert at[-1] == len(pos) - 1
    assert sum(waste(pos[b] - pos[a]) + penalty[b] for a, b in zip(at, at[1:])) == best[-1]


@pytest.mark.parametrize(("make", "path"), [(tokenization.Encoder, BYTE), (tokenization.Encoder, WORD), (trie_bpe.TrieEncoder, WORD)])
def test_encoders_equal_library_on_every_code_point(make, path):
    rng = tables.random.Random(4)
    marks = [c for c in range(0x300, 0x2000) if tokenization.re.match(r"[^\W\d_]|\w", chr(c)) is None]
    texts = [" ".join(f"A{chr(c)}b7 {chr(c)}'s" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in [*range(0, 0x20000, 64), *range(0x20000, 0x110000, 4096)]]
    texts += ["".join("aΣσ" + "".join(chr(rng.choice(marks)) for _ in range(3)) + rng.choice([" ", "\n", "  ", "\u00a0", "\u2003 ", "\x1c", "\x85"]) for _ in range(40)) for _ in range(300)]
    texts += ["<|endoftext|> x<|endoftext|>'s <|startoftext|>é", " lead", "trail ", " ", "\n\n x\n", "a\nb c\n", "I'M Σ'RE x'\u212a"]
    want = [packed(e.ids) for e in library(path).encode_batch(texts, add_special_tokens=False)]
    encoder = make(path)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[-300:]) == want[-300:] and encoder.encode([]) == [] and encoder.encode([None]) == [b""]


@pytest.mark.parametrize(("make", "path"), [(tokenization.Encoder, BYTE), (tokenization.Encoder, WORD), (trie_bpe.TrieEncoder, WORD)])
def test_pieces_are_cut_as_the_library_cuts_them(make, path):
    rng = tables.random.Random(11)
    parts = ["'", "'s", "'T", "'ll", "'re", "'ve", "'d", "''", "l", "v", "e", "a", "É", "é", "ß", "Σ", "1", "22", "½", "٣", "!", "…", "日本", "😀", " ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "​", "\x1c", "\x85", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts[: rng.choice((12, 36, 37))], k=rng.randint(0, 14))) for _ in range(6000)]
    assert make(path).encode(texts) == [packed(e.ids) for e in library(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_frequent_pieces_are_encoded_once(path, monkeypatch):
    """Words that every batch holds, beside new ones, stay known when what a worker keeps is full."""
    monkeypatch.setattr(tokenization, "PIECE_ENTRIES", 100)
    encoder, model, asked = tokenization.Encoder(path), library(path).model, defaultdict(int)

    class Counted:
        def tokenize(self, piece):
            asked[piece] += 1
            return model.tokenize(piece)

    encoder.model = Counted()
    common_words, t = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(1000, 1040)], library(path)
    for batch in range(8):
        texts = [f"x {w}{'!' * (batch + 1)} y" for w in common_words] + [f"x q{''.join(chr(97 + int(d)) for d in str(5000 + 30 * batch + k))} y" for k in range(30)]
        assert encoder.encode(texts) == [packed(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert max(asked.values()) == 1


@pytest.mark.parametrize("make", [tokenization.Encoder, trie_bpe.TrieEncoder])
def test_white_space_beyond_ascii_does_not_shift_words(make):
    texts = ["é", "\u00a0", "a\u00a0b"]
    assert make(WORD).encode(texts) == [packed(e.ids) for e in library(WORD).encode_batch(texts, add_special_tokens=False)]
