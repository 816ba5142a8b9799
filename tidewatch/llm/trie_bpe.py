"""BPE encoding of distinct words by prefix-sharing trie traversal, and decoding.

The last token of a prefix decides the whole encoding: the encoding of a prefix is that of the prefix before its last
token, and a token may follow another iff the two, put side by side, are left as they are by the merges. So each trie
node needs only the last token of its prefix. The distinct words of a batch, sorted, are the depth-first order of their
trie: the states on the path to a word are a stack, of which the part shared with the previous word is kept.

Defined results: a null text is the empty text and has no ids; repeated rows are encoded each; null doc_ids stay; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.tokenization import Encoder

END, PAIR_ENTRIES = "</w>", 1_000_000


class MergeTable:
    """Tokens and merges of a BPE file with a word-end suffix ("" if it has none)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self._names = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for r, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.rank.setdefault((vocab[a], vocab[b]), r)
            self.made_by.setdefault(made, (vocab[a], vocab[b], r))
        self.ordered = all(self.made_by[x][2] < r for a, b, r in self.made_by.values() for x in (a, b) if x in self.made_by)
        self._edges: dict[tuple[int, bool], tuple[list[int], list[int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}
        self.longest = max((len(t.removesuffix(suffix)) if suffix else len(t) for t in vocab), default=1)

    def symbols(self, token: int) -> list[int]:
        if token not in self.made_by:
            return [token]
        a, b, _ = self.made_by[token]
        return self.symbols(a) + self.symbols(b)

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        s, rank = list(symbols), self.rank
        while len(s) > 1:
            best = min((rank.get(p, 1 << 60), k) for k, p in enumerate(zip(s, s[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            s[k : k + 2] = [self._product(s[k], s[k + 1])]
        return s

    def _product(self, a: int, b: int) -> int:
        return self.vocab[self._names[a] + self._names[b]]

    def sound(self, token: int) -> bool:
        """Whether the merges make this token out of its own symbols."""
        known = self._sound.get(token)
        if known is None:
            known = self._sound[token] = self.merged(self.symbols(token)) == [token]
        return known

    def _edge(self, token: int, right: bool) -> tuple[list[int], list[int]]:
        """The symbols that stand at one end of a token while it is built, smallest first, and the rank that ends each."""
        found = self._edges.get((token, right))
        if found is None:
            chain, until = [token], [1 << 60]
            while chain[-1] in self.made_by:
                a, b, r = self.made_by[chain[-1]]
                chain.append(b if right else a)
                until.append(r)
            found = self._edges[token, right] = (chain[::-1], until[::-1])
        return found

    def may_follow(self, first: int, second: int) -> bool:
        """Whether [first, second] is the encoding of their concatenation: no merge across the border comes first."""
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > PAIR_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self._stays(first, second) if self.ordered else self.merged(self.symbols(first) + self.symbols(second)) == [first, second]
        return known

    def _stays(self, first: int, second: int) -> bool:
        left, left_until = self._edge(first, True)
        right, right_until = self._edge(second, False)
        i = j = 0
        rank = self.rank
        while True:
            across, a, b = rank.get((left[i], right[j]), 1 << 60), left_until[i], right_until[j]
            if across < a and across <= b and across < 1 << 60:
                return False
            if a == b == 1 << 60:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each of the sorted distinct words; prefixes shared with the word before are not encoded again."""
        vocab, suffix, may, sound, longest = self.vocab, self.suffix, self.may_follow, self.sound, self.longest
        last, size = [0], [0]  # by prefix length: last token of the prefix's encoding, its number of symbols
        before = ""
        for word in words:
            n, shared, most = len(word), 0, min(len(word), len(before), len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            stop = n - 1 if suffix else n
            if len(last) > stop + 1:
                del last[stop + 1 :], size[stop + 1 :]
            for d in range(len(last), stop + 1):
                for k in range(min(d, longest), 0, -1):
                    t = vocab.get(word[d - k : d])
                    if t is not None and (may(last[d - k], t) if d > k else True) and sound(t):
                        last.append(t)
                        size.append(k)
                        break
                else:
                    raise ValueError(f"no token ends {word[:d]!r}")
            out, d = [], n
            if suffix:
                for k in range(min(n, longest), 0, -1):
                    t = vocab.get(word[n - k :] + suffix)
                    if t is not None and (may(last[n - k], t) if n > k else True) and sound(t):
                        out.append(t)
                        d = n - k
                        break
                else:
                    raise ValueError(f"no token ends {word!r}")
            while d:
                out.append(last[d])
                d -= size[d]
            before = word
            yield word, out[::-1]


class TrieEncoder(Encoder):
    """``Encoder`` whose unseen pieces go through the trie instead of the library."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if self.family != "word" or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("the trie takes files of the lower-cased word family only")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.table = MergeTable(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        names = self.tok.get_vocab(with_added_tokens=True)
        self._names = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self._names[i] = t.encode()

    def _model_ids(self, spelt: list[str]) -> list[list[int]]:
        found = dict(self.table.encode_sorted(sorted(spelt)))
        return [found[s] for s in spelt]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode with special tokens kept, for files without a decoder: tokens joined by spaces."""
        return b" ".join(map(self._names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _round_trip(path: str, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = trie_encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ids = enc.encode(part.column(1))
                text = [enc.decode(x) for x in ids]
                arrays = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(x).hexdigest() for x in text])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_content:
                    arrays += [pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int64())), pa.array([x.decode() for x in text])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str, with_content: bool = False) -> DataFrame:
    """Digests of ids and of decoded text by document; ``with_content`` adds both themselves."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_content else "")
    return rows.mapInArrow(_round_trip(tokenizer, with_content), schema)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
