"""Exact, cached use of the ``tokenizers`` library inside Spark tasks.

Texts of the two families of tokenizer files used here (byte-level, and lower-cased words) are cut into pieces a batch at a
time, at the changes of class (letter, number, other, white space) of their code points; the class of each code point is
asked of the library's own splitter when it is first met, so that Unicode tables can't differ. Arrow numbers the distinct
pieces; those that earlier batches didn't meet are encoded by the library's model, and ids of whole texts are gathered by
Arrow. Normalisation of all but ASCII is the library's own. Texts with special tokens, and files of any other family, are
encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tidewatch.llm import common

#: Pieces a worker keeps before it goes on with those of the last batch alone; characters of a batch that are cut at once.
PIECE_ENTRIES, BATCH_BYTES = 300_000, 8 << 20

#: The split pattern of the lower-cased word family, a fixed value of its tokenizer files.
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def family(spec: dict) -> str:
    """'byte', 'word' or 'other'."""
    if any(t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        return "other"
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if model.get("type") != "BPE" or model.get("dropout"):
        return "other"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers") or [{}]
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == WORD_SPLIT and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"):
        return "word"
    return "other"


def _contents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings without nulls, and where each begins, with their end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8), offsets - offsets[0]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's own encoding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.family = family(spec)
        self.special = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self._letters = byte_alphabet()
        self.splitter = pre_tokenizers.Split(Regex(WORD_SPLIT), "removed", invert=True) if self.family == "word" else self.tok.pre_tokenizer
        self._class = np.full(0x110000, UNKNOWN, np.uint8)
        if self.family != "other":
            self._learn_classes(range(128))
        self.known_pieces = pa.array([], pa.large_binary())
        self.known_ids = pa.array([], pa.large_list(pa.uint32()))

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [pack(f"<{len(e.ids)}I", *e.ids) for k in range(0, len(texts), 2_000) for e in self.tok.encode_batch(texts[k : k + 2_000], add_special_tokens=False)]

    # cutting

    def _learn_classes(self, codes: Iterable[int]) -> None:
        """Ask the splitter beside which characters each code point stays."""
        split = self.splitter.pre_tokenize_str

        def one(text: str) -> bool:
            pieces = split(text)
            return len(pieces) == 1 and pieces[0][1] == (0, len(text))

        for code in codes:
            c = chr(code)
            number = bool(split(c)) if self.family == "word" else one("1" + c)
            self._class[code] = LETTER if one("a" + c) else OTHER if one("!" + c) else NUMBER if number else SPACE

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """Class of each byte's code point."""
        out = self._class[:256][data]  # those of lead and following bytes are replaced
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0xFF >> (size + 1))
            for k in (1, 2, 3):
                on = size > k
                code[on] = code[on] << 6 | data[lead[on] + k] & 0x3F
            self._learn_classes(np.unique(code[self._class[code] == UNKNOWN]).tolist())
            kinds = self._class[code]
            for k in (0, 1, 2, 3):
                on = size > k
                out[lead[on] + k] = kinds[on]
        return out

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts that lie end to end begin, with the end, and the class of each one's first byte."""
        n = len(data)
        kinds = self._classes(data)
        outer = np.zeros(n + 1, np.bool_)
        outer[bounds] = True
        edge = outer.copy()
        edge[1:n] |= kinds[1:] != kinds[:-1]
        if self.family == "word":  # numbers stand one by one
            edge[:n] |= (kinds == NUMBER) & (data & 0xC0 != 0x80)
        else:  # before a piece, the last character of white space is by itself, or leads the piece if it is a space
            at = np.flatnonzero(edge)
            ends = at[1:][kinds[at[:-1]] == SPACE]
            ends = ends[~outer[ends]]
            last = ends - 1
            for _ in range(3):
                last = last - (data[last] & 0xC0 == 0x80)
            edge[last] = True
            edge[ends[data[last] == 0x20]] = False
        mark = np.flatnonzero(data == 0x27)  # an apostrophe by itself takes one of seven endings
        mark = mark[edge[mark] & edge[mark + 1] & ~outer[mark + 1]]
        if len(mark):
            x, y = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
            one = np.isin(x, list(b"stmd"))
            two = ~one & ~outer[mark + 2] & ((x == 0x72) & (y == 0x65) | (x == 0x76) & (y == 0x65) | (x == 0x6C) & (y == 0x6C))
            edge[mark[one | two] + 1] = False
            edge[mark[one] + 2] = True
            edge[mark[two] + 3] = True
        at = np.flatnonzero(edge)
        return at, kinds[at[:-1]]

    def _normalised(self, chunks: pa.Array) -> pa.Array:
        """Chunks without ASCII white space as the file's normaliser leaves them; ASCII is only lower-cased."""
        odd = pc.invert(pc.string_is_ascii(chunks))
        some = chunks.filter(odd)
        data, bounds = _contents(some)
        white = np.zeros(len(some), np.bool_)  # of other than ASCII's, which the normaliser would run together with what joins the others
        white[np.searchsorted(bounds, np.flatnonzero(self._classes(data) == SPACE), side="right") - 1] = True
        lines, normal = np.array(some.to_pylist(), object), self.tok.normalizer.normalize_str
        for k in np.flatnonzero(white).tolist():
            lines[k] = normal(lines[k])
        rest = np.flatnonzero(~white)
        for lo in range(0, len(rest), 5_000):
            part = rest[lo : lo + 5_000]
            lines[part] = normal(" ".join(lines[part])).split(" ")
        lower = pc.ascii_lower(chunks)
        return pc.replace_with_mask(lower, odd, pa.array(lines, pa.large_string())) if len(lines) else lower

    # encoding

    def _model_ids(self, spelt: list[str]) -> list[list[int]]:
        """Ids of distinct pieces, spelt as the model takes them."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(s)] for s in spelt]

    def _learnt(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, by the model; it takes a printable character for each byte."""
        data, bounds = _contents(pieces)
        spelt, at = data.tobytes().decode("latin-1").translate(self._letters), bounds.tolist()
        ids, sizes = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for lo in range(0, len(pieces), 50_000):
            found = self._model_ids([spelt[a:b] for a, b in zip(at[lo : lo + 50_000], at[lo + 1 : lo + 50_001], strict=False)])
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        return pa.LargeListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes))), pa.array(np.concatenate(ids)))

    def _piece_ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece, of which each distinct one is looked up once."""
        named = pieces.dictionary_encode()
        met = named.dictionary
        place = pc.index_in(met, value_set=self.known_pieces)
        unseen = met.filter(place.is_null())
        at = place.fill_null(0).to_numpy().astype(np.int64)
        at[place.is_null().to_numpy(zero_copy_only=False)] = len(self.known_pieces) + np.arange(len(unseen))
        self.known_ids = pa.concat_arrays([self.known_ids, self._learnt(unseen)])
        self.known_pieces = pa.concat_arrays([self.known_pieces, unseen])
        out = self.known_ids.take(pa.array(at[named.indices.to_numpy()]))
        if len(self.known_pieces) > PIECE_ENTRIES:
            self.known_ids = self.known_ids.take(pa.array(at[:PIECE_ENTRIES]))
            self.known_pieces = met.take(pa.array(np.arange(min(len(met), PIECE_ENTRIES))))
        return out

    def _string_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, end to end, and where those of each begin, with their end."""
        data, bounds = _contents(texts)
        at, kinds = self._cut(data, bounds)
        pieces, starts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), at[:-1]
        if self.family == "word" and (blank := kinds == SPACE).any():
            pieces, starts = pieces.filter(pa.array(~blank)), starts[~blank]
        ids = self._piece_ids(pieces)
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[np.searchsorted(starts, bounds)]

    def _some(self, texts: pa.Array) -> list[bytes]:
        marked = np.zeros(len(texts), np.bool_)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(marked).tolist()
        bound = dict(zip(whole, self._alone(texts.filter(pa.array(marked)).to_pylist()), strict=True))
        if whole:
            texts = pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), texts)
        if self.family == "word":
            lists = pc.ascii_split_whitespace(texts)
            named = lists.flatten().dictionary_encode()
            ids, ends = self._string_ids(self._normalised(named.dictionary))
            chunks = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids)).take(named.indices)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids, ends = chunks.flatten().to_numpy(), chunks.offsets.to_numpy()[offsets - offsets[0]]
        else:
            ids, ends = self._string_ids(texts)
        data, at = ids.tobytes(), (ends * 4).tolist()
        out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k, x in bound.items():
            out[k] = x
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """None counts as the empty text."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        if self.family == "other":
            return self._alone(column.to_pylist())
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        while len(out) < len(column):
            at = len(out)
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right"))
            out += self._some(column.slice(at, max(1, upto - at)))
        return out

    def rest(self) -> None:
        """At the end of a task: the known pieces stay, they are few megabytes."""
        common.give_back()


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as all byte-level vocabularies write it: printable Latin-1 stays, the rest is moved past 255."""
    stay = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + k) for k, b in enumerate(moved)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
