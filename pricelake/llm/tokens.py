"""Public tokenizers in tasks, and where their texts may be cut.

A word of the byte-level tokenizer never continues over white space that follows something else, and no piece
of the other one holds its space after another character. So a text cut before each space that follows no white
space is tokenised word by word, and of equal words of a batch one is tokenised. ``check_pieces``
verifies the vocabulary's part of that.

A tokenizer is named by the path of its file; a bare file name is one of the installed public ones.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Mark of a space in pieces.
MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?= )")
#: A character that is no white space, as a pattern of Arrow.
BLACK = "[^\\pZ\\s\\x0b\\x1c-\\x1f\\x{85}]"
_ODD = re.compile(r"\s ")


def path_of(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def byte_bpe(name: str = BYTE_BPE) -> Tokenizer:
    """The byte-level tokenizer; strings of special tokens are plain text."""
    out = Tokenizer.from_file(path_of(name))
    out.encode_special_tokens = True
    return out


def ids_of(texts: list[str], name: str = BYTE_BPE) -> list[list[int]]:
    return [e.ids for e in byte_bpe(name).encode_batch_fast(texts, add_special_tokens=False)]


@cache
def byte_tokens(name: str = BYTE_BPE) -> list[bytes]:
    """The bytes of each id: the tokenizer writes printable bytes as themselves and the others, in order, from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    t = byte_bpe(name)
    special = {i for i, a in t.get_added_tokens_decoder().items() if a.special}
    return [b"" if i in special else bytes(byte[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]


# Fixed value: how the byte-level tokenizer parts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of a word that is encoded with others, longer ones go alone; of a text that the quicker library takes.
LONG_WORD, LONG_TEXT = 200, 1 << 20


@cache
def ranked(name: str = BYTE_BPE) -> tiktoken.Encoding:
    """The same vocabulary, in which ids are ranks, for a quicker library; a test holds the two against each other on all characters."""
    ranks = {b: i for i, b in enumerate(byte_tokens(name)) if b}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_ids(text: str, name: str = BYTE_BPE) -> list[int]:
    return ranked(name).encode_ordinary(text) if len(text) <= LONG_TEXT else ids_of([text], name)[0]


@cache
def sizes_of(side: str, name: str) -> np.ndarray:
    """Bytes of each id."""
    return np.array([len(b) for b in (byte_tokens if side == "a" else piece_tokens)(name)], np.int64)


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists, and how many each has."""
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n


def byte_words(spaced: pa.Array, name: str = BYTE_BPE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each encoded as it stands, and how many each has.

    Words with a space before and none behind are encoded as one text, for that text is cut between them.
    """
    joint = pc.and_(pc.less_equal(pc.binary_length(spaced), LONG_WORD), pc.match_substring_regex(spaced, f"^ (?s:.*){BLACK}$"))
    some, other = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (joint, pc.invert(joint)))
    n, own = np.zeros(len(spaced), np.int64), spaced.filter(joint)
    ids = np.array(ranked(name).encode_ordinary(data_of(own).tobytes().decode()), np.int64)
    ends = np.cumsum(sizes_of("a", name)[ids])
    n[some] = np.diff(np.searchsorted(ends, np.cumsum(byte_sizes(own)), "right"), prepend=0)
    if not len(other):
        return ids, n
    more, n[other] = flat(ids_of(spaced.take(pa.array(other)).to_pylist(), name))
    # Back into the order of the words.
    begin, order = np.zeros(len(spaced), np.int64), np.concatenate((some, other))
    begin[order] = np.cumsum(n[order]) - n[order]
    return np.concatenate((ids, more))[gathered(begin, n)], n


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def data_of(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts of an array without nulls, one after the other."""
    _, at, data = texts.cast(pa.large_string()).buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def bytes_of(ids: np.ndarray, side: str, name: str) -> np.ndarray:
    """The bytes of all ids, one after the other."""
    every, size = token_bytes(side, name), sizes_of(side, name)
    return every[gathered((np.cumsum(size) - size)[ids], size[ids])]


@cache
def token_bytes(side: str, name: str) -> np.ndarray:
    return np.frombuffer(b"".join((byte_tokens if side == "a" else piece_tokens)(name)), np.uint8)


def gathered(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of stretches of n from begin, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)


def piece_words(spaced: pa.Array, name: str = PIECE_BPE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each with a space before it, encoded as it stands, and how many each has.

    Words without a space inside or behind go a few together, for that text is cut between them too.
    """
    joint = pc.match_substring_regex(spaced, f"^ [^ {MARK}]+$").to_numpy(zero_copy_only=False)
    each = spaced.to_pylist()
    own = each if joint.all() else [each[i] for i in np.flatnonzero(joint).tolist()]
    found, _ = flat(piece_bpe(name).encode(["".join(own[i : i + 16])[1:] for i in range(0, len(own), 16)], num_threads=1))
    n = np.zeros(len(each), np.int64)
    # A word begins where its space does; these words give back their bytes.
    ends = np.cumsum(sizes_of("b", name)[found])
    some, other = np.flatnonzero(joint), np.flatnonzero(~joint)
    n[some] = np.diff(np.searchsorted(ends, np.cumsum(byte_sizes(spaced.take(pa.array(some)))), "right"), prepend=0)
    if not len(other):
        return found, n
    more, n[other] = flat(pieces_of([each[i] for i in other.tolist()], name))
    begin, order = np.zeros(len(each), np.int64), np.concatenate((some, other))
    begin[order] = np.cumsum(n[order]) - n[order]
    return np.concatenate((found, more))[gathered(begin, n)], n


@cache
def piece_bpe(name: str = PIECE_BPE):
    import sentencepiece

    out = sentencepiece.SentencePieceProcessor(model_file=path_of(name))
    check_pieces([out.id_to_piece(i) for i in range(out.get_piece_size())])
    return out


def check_pieces(pieces: list[str]) -> None:
    inner = re.compile(f"[^{MARK}]{MARK}|\0")
    if bad := [p for p in pieces if inner.search(p)]:
        raise ValueError(f"texts cannot be cut for these pieces: {bad[:5]}")


def pieces_of(texts: list[str], name: str = PIECE_BPE) -> list[list[int]]:
    """Ids of texts as they are, without the space that the tokenizer adds: a byte that joins nothing goes before each."""
    return [ids[2:] for ids in piece_bpe(name).encode(["\0" + t for t in texts], num_threads=1)]


@cache
def piece_tokens(name: str = PIECE_BPE) -> list[bytes]:
    """The bytes of each id: the piece in UTF-8 with the mark as a space, or one byte."""
    p = piece_bpe(name)
    text = lambda i: p.id_to_piece(i)
    return [bytes([int(text(i)[3:5], 16)]) if p.is_byte(i) else text(i).replace(MARK, " ").encode() for i in range(p.get_piece_size())]


@cache
def piece_pairs(name: str = PIECE_BPE) -> frozenset[str]:
    """All pairs of neighbouring characters inside pieces: between two others no piece can lie."""
    p = piece_bpe(name)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()) if not p.is_byte(i))
    return frozenset(x[i : i + 2] for x in pieces for i in range(len(x) - 1))


def words(text: str) -> list[str]:
    """``text`` cut before each space that follows something else than white space; that space is left out, the first word has none."""
    if _ODD.search(text) or text[:1].isspace():
        first, *rest = _CUT.split(text)
        return [first, *[w[1:] for w in rest]]
    return text.split(" ")


def slices(batches: Iterator[pa.RecordBatch], size: int = 5_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of text, short ones put together and long ones parted."""
    held, so_far = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(batch):
            start = int(ends[row - 1]) if row else 0
            end = max(row + 1, int(np.searchsorted(ends, start + size - so_far, "right")))
            held.append(batch.slice(row, end - row))
            so_far += int(ends[end - 1]) - start
            row = end
            if so_far >= size or row < len(batch):
                yield from alone(pa.concat_batches(held))
                held, so_far = [], 0
    if held:
        yield from alone(pa.concat_batches(held))


def alone(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, without searches for cycles among its many lists of numbers; what it took is given back after it."""
    gc.disable()
    yield batch
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()


class Distinct:
    """The distinct words of texts (null ones are empty), and the number of each word of each text.

    A text's words are ``at[begin : begin + n]``. With ``first`` a text's first word, which no space precedes, is a
    word of its own kind, held by the numbers from ``heads`` on.
    """

    def __init__(self, column: pa.Array, first: bool = False) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        white = "[" + BLACK[2:]
        odd = pc.match_substring_regex(column, f"^{white}|{white} ")
        skip = pc.or_(odd, pc.equal(pc.binary_length(column), 0))
        plain = pc.split_pattern(pc.if_else(skip, pa.scalar(None, pa.large_string()), column), " ")
        self.n = pc.fill_null(pc.list_value_length(plain), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        every, rest = plain.flatten(), []
        self.begin = np.cumsum(self.n) - self.n
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = words(column[row].as_py())
            self.begin[row], self.n[row] = len(every) + len(rest), len(own)
            rest += own
        every = (pa.concat_arrays([every, pa.array(rest, pa.large_string())]) if rest else every).dictionary_encode()
        self.at = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = every.dictionary
        self.heads = len(self.words)
        if first and (head := np.flatnonzero(self.n)).size:
            own, back = np.unique(self.at[self.begin[head]], return_inverse=True)
            self.at[self.begin[head]] = self.heads + back
            self.words = pa.concat_arrays([self.words, self.words.take(pa.array(own))])

    def spaced(self) -> pa.Array:
        """The words with the space before them."""
        rest, (empty, space) = self.words[: self.heads], (pa.scalar(x, pa.large_string()) for x in ("", " "))
        return pa.concat_arrays([pc.binary_join_element_wise(empty, rest, space), self.words[self.heads :]])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its words' values."""
        total = np.concatenate(([0], np.cumsum(values[self.at])))
        return total[self.begin + self.n] - total[self.begin]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; empty stretches are 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
