"""Exact byte-level BPE encoding by backtracking, and decoding by an offset table.

A text is cut into pieces by the vocabulary's own pre-tokenizer pattern. An
Aho-Corasick automaton over the token bytes gives the longest token at every
start. Tokens are taken greedily, each checked against its left neighbour in a
pair-compatibility table, and the encoder steps back to a shorter token (or to
the previous position) when a pair could not have come out of the merges. Every
position is refused at most once, so the work is linear in the piece. Pieces of up to 64 characters and pairs
are kept in bounded tables. Decoding joins slices of one byte string.

Nulls are treated as empty texts: no ids, and the decoded text is "". Texts may
be of any length; repeated rows are encoded alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Memo, small_batches

#: Fixed value: the split pattern of byte-level BPE vocabularies, for Latin texts. Other texts, and all texts of a file with another pre-tokenizer, are cut by the library.
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
LATIN_PIECES = re.compile(rf""" ?[{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
PIECES, PAIRS = 200_000, 150_000  # kept by each worker: about 40 MB
LIBRARY_PIECES = 500_000  # kept by each worker that encodes by the library: about 80 MB
NOT_LATIN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes get the
    letters from U+0100 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Splitter:
    """Cuts a text into pieces and special tokens as the tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, cutter = spec["added_tokens"], spec["pre_tokenizer"] or {}
        self.known_pattern = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.special = {x["content"]: x["id"] for x in added}
        self.any_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None

    def cut(self, text: str) -> list[str]:
        if self.known_pattern and NOT_LATIN.search(text) is None:
            return LATIN_PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special token is a piece of its own."""
        if self.any_special is None or self.any_special.search(text) is None:
            return self.cut(text)
        parts = self.any_special.split(text)
        return [p for n, part in enumerate(parts) for p in ([part] if n % 2 else self.cut(part))]


class Bpe:
    """Backtracking encoder and offset-table decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        self.splitter = Splitter(path)  # first: it reads the file too, and lets go of it
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {as_bytes(t): i for t, i in model.pop("vocab").items()}
        self.automaton = ahocorasick.Automaton()
        self.byte_id = {}
        for token, i in vocab.items():
            if len(token) == 1:  # the least that starts anywhere, so no match is needed
                self.byte_id[token.decode("latin-1")] = i
            else:
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, i))
        self.automaton.make_automaton()
        # by id, as numbers of 4 bytes: merge rank and halves of each token (single bytes have neither), length, next shorter token
        self.rank, self.left_half, self.right_half, self.length, self.next_shorter = (array("i", [-1]) * (max(vocab.values()) + 1) for _ in range(5))
        self.merged = {}
        for rank, pair in enumerate(model.pop("merges")):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a << 32 | b] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left_half[whole], self.right_half[whole] = rank, a, b
        for t, i in vocab.items():
            self.length[i], self.next_shorter[i] = len(t), self._prefix(t, vocab)
        self.compatible = Memo(self._compatible, PAIRS, None)
        by_id = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.splitter.special.items()}
        self.tokens = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())  # bytes and offsets
        self.packed = Memo(self._packed, PIECES)

    @staticmethod
    def _prefix(token: bytes, vocab: dict) -> int:
        """The longest other token that starts this one, else -1."""
        return next((vocab[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in vocab), -1)

    def _compatible(self, pair: int) -> bool:
        """Whether merging leaves this pair of tokens (left << 32 | right) apart.

        The merges inside both tokens are undone, last one first. If the two
        tokens next to the cut have a merge that would have come before the
        merge just undone, the cut would have been closed.
        """
        left, right = pair >> 32, pair & 0xFFFFFFFF
        before, ties_close = float("inf"), False
        while True:
            rank = self.merged.get(left << 32 | right)
            if rank is not None and (rank < before or ties_close and rank == before):
                return False
            rank_left, rank_right = self.rank[left], self.rank[right]
            if rank_left < 0 and rank_right < 0:
                return True
            # Of one merge at several places the leftmost goes first, so the right token's is undone first.
            if rank_left > rank_right:
                before, ties_close, left = rank_left, False, self.right_half[left]
            else:
                before, ties_close, right = rank_right, True, self.left_half[right]

    def _packed(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece)).tobytes()

    def encode_piece(self, piece: str) -> list[int]:
        if piece in self.splitter.special:
            return [self.splitter.special[piece]]
        raw = piece.encode("utf-8").decode("latin-1")
        longest = [*map(self.byte_id.__getitem__, raw), -1]
        for end, (back, i) in self.automaton.iter(raw):  # ends ascend, so the last of a start is its longest
            longest[end - back] = i
        lengths, compatible, refused, out, at, left, token = self.length, self.compatible, None, [], 0, -1, longest[0]
        while token >= 0:
            end = at + lengths[token]
            if (left < 0 or compatible[left << 32 | token]) and (refused is None or end not in refused):
                out.append(token)
                at, left, token = end, token, longest[end]
                continue
            token = self.next_shorter[token]
            if token < 0:
                refused = refused or set()
                refused.add(at)
                token = out.pop()
                at -= lengths[token]
                left = out[-1] if out else -1
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.splitter.pieces(text))) if text else b""

    def decode(self, ids) -> str:
        return self.decode_many(np.asarray(ids, np.int64), [len(ids)])[0]

    def decode_many(self, flat: np.ndarray, sizes, chunk: int = 500_000) -> list[str]:
        """The texts of several documents whose ids lie one after another in ``flat``."""
        out, ends, first = [], np.cumsum(sizes), 0
        while first < len(ends):
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + chunk, "right")))
            _, offsets, raw = self.tokens.take(pa.array(flat[begin : ends[last - 1]])).buffers()
            offsets = np.frombuffer(offsets, np.int64)
            cuts = offsets[np.concatenate([[begin], ends[first:last]]) - begin].tolist()
            out += [str(memoryview(raw)[a:b], "utf-8", "replace") if b > a else "" for a, b in zip(cuts, cuts[1:], strict=False)]
            first = last
        return out


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@functools.lru_cache(maxsize=2)
def id_width(path: str) -> int:
    """Bytes that every id of the vocabulary fits in: 2 or 4."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) < 1 << 16 else 4


@functools.lru_cache(maxsize=2)
def library_pieces(path: str) -> tuple[Splitter, Memo]:
    """A splitter and a memo of the tokenizers library's ids for each piece.

    A piece is already cut, so it goes straight to the library's model, in byte
    letters; special tokens, and all pieces of a file with a normaliser, go
    through the whole library.
    """
    splitter, form = Splitter(path), "H" if id_width(path) == 2 else "I"
    library, model = splitter.library, splitter.library.model
    letters = {byte: letter for letter, byte in byte_letters().items()}

    def ids(piece: str) -> bytes:
        if library.normalizer is not None or piece in splitter.special:
            found = library.encode(piece, add_special_tokens=False).ids
        else:
            found = [x.id for x in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
        return array(form, found).tobytes()

    return splitter, Memo(ids, LIBRARY_PIECES)


IDS = T.ArrayType(T.IntegerType(), False)


def _id_lists(b: Bpe, texts: pa.Array) -> pa.ListArray:
    flat = [b.encode(x.as_py()) for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), np.int32)))


def _texts(b: Bpe, lists: pa.ListArray) -> pa.Array:
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    return pa.array(b.decode_many(lists.flatten().to_numpy(zero_copy_only=False), sizes), pa.string())


def encode(text: Column, path: str | None = None) -> Column:
    """``array<int>`` of the ids of each whole text."""
    small_batches()
    path = path or default_vocabulary()

    @F.arrow_udf(IDS)
    def ids(texts: pa.Array) -> pa.Array:
        return _id_lists(bpe(path), texts)

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of each array of ids; null ids give an empty text."""
    small_batches()
    path = path or default_vocabulary()

    @F.arrow_udf(T.StringType())
    def texts(arrays: pa.Array) -> pa.Array:
        return _texts(bpe(path), arrays)

    return texts(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """``struct<ids, text>``: the ids of each whole text, and the text that they decode to.

    Spark fuses ``decode`` over ``encode`` with ``encode`` in one worker, which
    then encodes each text twice; this encodes it once.
    """
    small_batches()
    path = path or default_vocabulary()

    @F.arrow_udf(T.StructType([T.StructField("ids", IDS), T.StructField("text", T.StringType())]))
    def both(texts: pa.Array) -> pa.Array:
        b = bpe(path)
        lists = _id_lists(b, texts)
        return pa.StructArray.from_arrays([lists, _texts(b, lists)], ["ids", "text"])

    return both(text)


def library_encode(text: Column, path: str | None = None, end_id: int | None = None) -> Column:
    """Ids by the tokenizers library, packed as little-endian unsigned integers of ``id_width`` bytes.

    Pieces are independent in byte-level BPE, so the library encodes each
    distinct piece once per worker. ``end_id`` is appended to each document.
    """
    small_batches()
    path = path or default_vocabulary()
    end = b"" if end_id is None else end_id.to_bytes(id_width(path), "little")

    @F.arrow_udf(T.BinaryType())
    def packed(texts: pa.Array) -> pa.Array:
        splitter, memo = library_pieces(path)
        return pa.array([b"".join(map(memo.__getitem__, splitter.pieces(x.as_py() or ""))) + end for x in texts], pa.binary())

    return packed(text)
