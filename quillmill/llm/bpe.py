"""Byte-level BPE encoding by a pair occurrence index, and decoding.

The distinct words of a group of texts are laid end to end as one array of symbols. An index maps each adjacent pair
that has a merge rank to all its positions; a heap holds the ranks that are active. The lowest rank is applied to all
its positions from left to right, each merge updates the neighbours' pairs in the index, and so on until no rank is
active. A merge makes only pairs of later ranks, so this equals merging word by word. Words met before come from a
bounded cache; the index only takes new ones.

Defined results: a null text is empty (no ids); a special token's string in a text is that token, as the tokenizers
library has it; bytes that are no UTF-8 decode to U+FFFD; repeated rows are encoded each; other columns are unread.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillmill.llm.common import doc_texts, worker_cache
from quillmill.llm.tokens import BARE, PieceEncoder, Pool, byte_symbols, text_slices

#: Fixed value: the published pattern that cuts text into words for byte-level BPE; \s is Unicode's White_Space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class PairIndexBPE(PieceEncoder):
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special_ids = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_ids = [vocab[s] for s in symbols]
        self.size = max([*vocab.values(), *self.special_ids.values()]) + 1
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a] * self.size + vocab[b]] = rank, vocab[a + b]
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, k in self.special_ids.items():
            self.bytes_of[k] = token.encode()
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special_ids, key=len, reverse=True))) + ")") if self.special_ids else None
        super().__init__("spaced", list(self.special_ids), "<u4")
        self.decoded = Pool.of(self.bytes_of, "u1")

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The packed token ids of each word."""
        size, merges = self.size, self.merges
        symbols: list[int] = []
        ends = []
        for w in words:
            symbols.extend(map(self.byte_ids.__getitem__, w))
            symbols.append(-1)  # between words: in no pair
            ends.append(len(symbols) - 1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for k in range(n - 1):
            a, b = symbols[k], symbols[k + 1]
            if a >= 0 and b >= 0 and (pair := a * size + b) in merges:
                if pair in places:
                    places[pair].append(k)
                else:
                    places[pair] = [k]
        active = [(merges[p][0], p) for p in places]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            a, b = divmod(pair, size)
            new = merges[pair][1]
            for k in sorted(places.pop(pair)):
                if symbols[k] != a or symbols[right := after[k]] != b:
                    continue  # another merge has taken one of the two
                symbols[k], symbols[right] = new, -2
                after[k] = beyond = after[right]
                before[beyond] = k
                left = before[k]
                for at, made in ((left, symbols[left] * size + new if left >= 0 and symbols[left] >= 0 else -1), (k, new * size + symbols[beyond] if symbols[beyond] >= 0 else -1)):
                    if made in merges:
                        if made in places:
                            places[made].append(at)
                        else:
                            places[made] = [at]
                            heapq.heappush(active, (merges[made][0], made))
        out, begin = [], 0
        for end in ends:
            out.append(array("I", [s for s in symbols[begin:end] if s >= 0]).tobytes())
            begin = end + 1
        return out

    def encode_pieces(self, pieces: pa.Array) -> Pool:
        return Pool.of(self._encode([p[1:] if p[:1] == BARE else f" {p}" for p in pieces.to_pylist()]), self.dtype)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.words.findall(t) for t in texts]
        words = list(dict.fromkeys(w for ws in cut for w in ws))
        ids = dict(zip(words, self.merge_all([w.encode() for w in words]), strict=True))
        return [b"".join(map(ids.__getitem__, ws)) for ws in cut]

    def encode_whole(self, text: str) -> bytes:
        parts = [p for p in self.cut.split(text) if p] if self.cut else [text]
        return b"".join(self.special_ids[p].to_bytes(4, "little") if p in self.special_ids else self._encode([p])[0] for p in parts)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded.gather(ids.astype(np.int64))[0].tobytes().decode("utf-8", errors="replace")


def coder(path: str) -> PairIndexBPE:
    return worker_cache(("pair index", path), lambda: PairIndexBPE(path))


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (packed u32, little-endian), decoded: the text that the ids decode to."""
    return _mapped(docs, tokenizer_path, "doc_id long, ids binary, decoded string", lambda doc_id, ids, decoded: (doc_id, ids, decoded))


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded texts don't leave the worker."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda doc_id, ids, decoded: (doc_id, len(ids) // 4, sha(ids), sha(decoded.encode())))


def _mapped(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def run(batches):
        bpe = coder(path)
        for part in (x for b in batches for x in text_slices(b)):
            rows = [row(doc_id, ids.tobytes(), bpe.decode(ids)) for doc_id, ids in zip(part.column(0).to_pylist(), bpe.encode_each(part.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return doc_texts(docs).mapInArrow(run, schema)
