"""Whole texts to token ids, piece by piece.

Texts repeat their words, so a worker encodes each distinct piece of text once. A batch is cut into pieces,
dictionary-encoded and looked up among the known pieces by Arrow; only pieces not met before go through the tokenizer;
the ids of all texts are then gathered from the pieces' ids at once. Texts are cut only where the tokenizer's own rules
always cut, so the ids are those of the whole text:
- a tokenizer that drops white space and splits at it: pieces are what ASCII white space separates;
- a byte-level one: text is cut before a single space and around a single line end. Texts where white space meets white
  space, with white space beyond ASCII or with a special token's string are encoded whole;
- any other: texts are encoded whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmill.llm.common import give_back, load_tokenizer, worker_cache

_WS = " \\t\\n\\r\\x0b\\x0c"
#: White space beyond ASCII, or white space beside white space (RE2), or the mark below.
UNEVEN = f"[{_WS}][{_WS}]|[\\x01\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"
#: Begins a piece that has no space before it.
BARE = "\x01"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies: printable Latin-1 stands for itself, the
    other bytes are numbered from U+0100 on."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_AS_SYMBOLS = dict(enumerate(byte_symbols()))


class Pool:
    """Runs of values of one type, laid end to end, by number."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes, self.starts = values, sizes, np.cumsum(sizes) - sizes

    @staticmethod
    def of(runs: list[bytes], dtype: str) -> Pool:
        return Pool(np.frombuffer(b"".join(runs), dtype), np.fromiter(map(len, runs), np.int64, len(runs)) // np.dtype(dtype).itemsize)

    def gather(self, numbers: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers end to end, and where each begins and the last ends."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(ends[-1], self.values.dtype)
        for k in range(0, len(numbers), step):
            a, b = ends[k], ends[min(k + step, len(numbers))]
            out[a:b] = self.values[np.repeat(self.starts[numbers[k : k + step]] - ends[k : k + step][: len(sizes[k : k + step])], sizes[k : k + step]) + np.arange(a, b)]
        return out, ends


class KnownPieces:
    """Ids by piece, kept within a Python worker. Beyond `most` pieces the older half goes; frequent ones are soon back."""

    def __init__(self, dtype: str, most: int = 250_000):
        self.dtype, self.most = dtype, most
        self.keys = pa.array([], pa.string())
        self.pool = Pool.of([], dtype)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, pieces: pa.Array, ids: Pool) -> None:
        self.keys = pa.concat_arrays([self.keys, pieces])
        self.pool = Pool(np.concatenate([self.pool.values, ids.values]), np.concatenate([self.pool.sizes, ids.sizes]))

    def shrink(self) -> None:
        if (n := len(self.keys)) > self.most:
            self.keys = pa.concat_arrays([self.keys[n // 2 :]])
            self.pool = Pool(self.pool.values[self.pool.starts[n // 2] :].copy(), self.pool.sizes[n // 2 :])


class PieceEncoder:
    """Encodes Arrow arrays of texts. `encode_pieces` (distinct new pieces -> their ids) is the tokenizer."""

    def __init__(self, kind: str, special: list[str], dtype: str, lowers: bool = False):
        self.kind, self.special, self.dtype, self.lowers = kind, special, dtype, lowers
        self.known = KnownPieces(dtype)

    def encode_pieces(self, pieces: pa.Array) -> Pool:
        raise NotImplementedError

    def encode_whole(self, text: str) -> bytes:
        raise NotImplementedError

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts cannot be cut."""
        if self.kind == "whole":
            return np.ones(len(texts), bool)
        whole = pc.match_substring_regex(texts, UNEVEN) if self.kind == "spaced" else pc.is_null(texts)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s, ignore_case=self.lowers))
        return whole.to_numpy(zero_copy_only=False)

    def ids_of(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces in the pool of known ones, to which new pieces are added."""
        numbers = self.known.find(pieces)
        if (numbers < 0).any():
            new = pieces.filter(pa.array(numbers < 0))
            ids = self.encode_pieces(new)
            numbers[numbers < 0] = len(self.known.keys) + np.arange(len(new))
            self.known.add(new, ids)
        return numbers

    def _numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct piece the number of its ids' run and that of its mark's, -1 if it has none. A mark after
        letters is a word of its own to both kinds of tokenizer, so words with and without one are known once."""
        two = self._ends_in_mark(pieces)
        stems = pc.if_else(two, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        bare = BARE if self.kind == "spaced" else ""
        marks = pc.if_else(two, pc.binary_join_element_wise(bare, pc.utf8_slice_codeunits(pieces, -1), ""), None)
        coded = pa.concat_arrays([stems, marks]).dictionary_encode()
        numbers = self.ids_of(coded.dictionary)
        where = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        found = np.where(where >= 0, numbers[where], -1) if len(numbers) else where.astype(np.int64)
        return found[: len(pieces)], found[len(pieces) :]

    def _ends_in_mark(self, pieces: pa.Array) -> pa.Array:
        """Which pieces are letters and a mark. Beyond ASCII that holds only where the tokenizer sees the same letters:
        a normaliser may turn one letter into a letter and a combining mark, which runs on into what follows."""
        two = pc.match_substring_regex(pieces, f"^{BARE}?\\p{{L}}+[.,;:!?]$")
        beyond = pc.and_(two, pc.invert(pc.string_is_ascii(pieces)))
        at = np.flatnonzero(beyond.to_numpy(zero_copy_only=False))
        if not len(at):
            return two
        held = two.to_numpy(zero_copy_only=False).copy()
        held[at] = [self.is_letters(p[:-1].removeprefix(BARE)) for p in pieces.take(pa.array(at)).to_pylist()]
        return pa.array(held)

    def is_letters(self, stem: str) -> bool:
        """Whether letters beyond ASCII stay, as they are, one word to the tokenizer."""
        return stem.isalpha()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and for each text where its ids begin, then where the last end."""
        self.known.shrink()
        whole = self._whole(texts)
        cut = pc.if_else(pa.array(~whole), texts, "") if whole.any() else texts
        if self.kind == "words":
            parts = pc.ascii_split_whitespace(pc.ascii_lower(cut) if self.lowers else cut)
        else:  # a text's first piece and those beside line ends are bare
            marked = pc.replace_substring(cut, "\n", f" {BARE}\n {BARE}")
            parts = pc.split_pattern(pc.binary_join_element_wise(BARE, marked, ""), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        first, second = self._numbers(coded.dictionary)
        codes = coded.indices.to_numpy()
        # a piece with a mark is two runs
        at = np.arange(len(codes)) + np.concatenate([[0], np.cumsum(second[codes] >= 0)])[:-1] if len(codes) else codes
        runs = np.full(int(len(codes) + (second[codes] >= 0).sum()), -1, np.int64)
        runs[at] = first[codes]
        runs[runs < 0] = second[codes][second[codes] >= 0]
        ids, ends = self.known.pool.gather(runs)
        ends = ends[np.concatenate([at, [len(runs)]])[bounds - bounds[0]]]
        if not whole.any():
            return ids, ends
        # put in the texts that were encoded whole
        each = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole).tolist():
            each[k] = np.frombuffer(self.encode_whole(texts[k].as_py()), self.dtype)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

    def encode_each(self, texts: pa.Array) -> list[np.ndarray]:
        ids, ends = self.encode(texts)
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class TextEncoder(PieceEncoder):
    """Ids by the tokenizers library, as little-endian unsigned integers of two bytes, or four for large vocabularies."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        spec = json.loads(self.tokenizer.to_str())
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        super().__init__(self._kind(spec), [x["content"] for x in spec["added_tokens"]], f"<u{self.width}", any(x["type"] == "Lowercase" for x in steps))

    @staticmethod
    def _kind(spec: dict) -> str:
        norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE":
            return "whole"
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "spaced"
        steps = pre.get("pretokenizers", [])
        split = steps[0] if steps and steps[0]["type"] == "Split" else {}
        drops = split.get("invert") and split["behavior"] == "Removed" and "[\\p{L}]+" in split["pattern"].get("Regex", "")
        known = {x["type"] for x in norm.get("normalizers", [])} <= {"NFC", "Lowercase", "Replace"}
        return "words" if drops and known and [x["type"] for x in steps[1:]] == ["ByteLevel"] else "whole"

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode_whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def is_letters(self, stem: str) -> bool:
        return stem.isalpha() and (self.kind != "words" or self._is_normal(stem))

    @staticmethod
    def _is_normal(text: str) -> bool:
        return unicodedata.is_normalized("NFC", text) and text == text.lower()

    def encode_pieces(self, pieces: pa.Array) -> Pool:
        """Pieces of letters are one word to both kinds of tokenizer and go to the library's model at once; what else
        there is goes the whole way."""
        texts = [self._plain(p) for p in pieces.to_pylist()]
        runs = [self._merged(t) if t and t.removeprefix(" ").isalpha() else b"" for t in texts]
        rest = [k for k, (t, r) in enumerate(zip(texts, runs, strict=True)) if t and not r]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            runs[k] = self._packed(x.ids)
        return Pool.of(runs, self.dtype)

    def _plain(self, piece: str) -> str:
        if self.kind != "spaced":
            return piece
        return piece[1:] if piece[:1] == BARE else f" {piece}"

    def _merged(self, text: str) -> bytes:
        """A word of letters through the library's model; nothing if it would first be normalised."""
        if self.kind == "words" and not text.isascii() and not self._is_normal(text):
            return b""
        symbols = text if text.isascii() and text[0] != " " else text.encode().decode("latin-1").translate(_AS_SYMBOLS)
        return self._packed([t.id for t in self.tokenizer.model.tokenize(symbols)])


def encoder(path: str) -> TextEncoder:
    return worker_cache(("encoder", path), lambda: TextEncoder(path))


def text_slices(batch: pa.RecordBatch, column: int = 1, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most_bytes` of text, so that a worker's memory doesn't follow the batch size; what
    was freed goes back to the system after each batch, as workers live on."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes) // most_bytes
    for k in np.unique(number).tolist():
        at = np.flatnonzero(number == k)
        yield batch.slice(int(at[0]), len(at))
    give_back()


def in_groups(rows: Iterable[tuple], text_at: int, most_chars: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in runs of about `most_chars` characters."""
    run, chars = [], 0
    for row in rows:
        run.append(row)
        chars += len(row[text_at])
        if chars >= most_chars:
            yield run
            run, chars = [], 0
    if run:
        yield run


def batch_rows(batch) -> Iterator[tuple]:
    """The rows of an Arrow batch, converted value by value: a batch of long texts is never held twice."""
    columns = list(batch.columns)
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in columns)
