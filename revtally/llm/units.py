"""Texts cut into units that a tokenizer treats each on its own, and a memo of their ids.

A text may be cut before a single space between two visible characters: neither a byte-level
pattern nor a vocabulary without spaces inside of its pieces joins anything across such a place.
A unit is what lies between two cuts, without the space. Units repeat, texts don't, so a library is
asked once per unit. Nothing of a text is left out: a text without such a place is one unit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

#: Bytes of text worked on at a time; units, and pieces, in a memo before it is emptied; ids that they
#: may have on average before it is emptied sooner.
CHUNK, MEMO, PIECES, LONG = 2 << 20, 1_000_000, 500_000, 8
#: New units that are looked at as one text.
TOGETHER = 1_000

# behind the space stands what follows it, as a search for a space is fast
_UNSAFE = re.compile(r" (?:(?<![!-~\w] )|(?![!-~\w]))")
_CUT = re.compile(r" (?<=[!-~\w] )(?=[!-~\w])")

# Fixed value: how byte-level tokenizers cut a text into pieces.
_PIECE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters of which all libraries know alike whether they are letters, digits or white space.
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\u024f]*")

#: A unit that has lost the space before it; a tuple of one string is a text's first, which has lost none.
Unit = str | tuple[str]
#: For some units: ids one after another, how many each has, and whether they keep its bytes.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]
Side = Callable[[list[Unit]], Encoded]


def units(text: str) -> list[str]:
    return _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about CHUNK bytes."""
    weight = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(weight) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def whole(unit: Unit) -> str:
    return unit[0] if isinstance(unit, tuple) else f" {unit}"


class ByteLevel:
    """Units by a byte-level tokenizer of the tokenizers library. Pieces of plain characters are
    cut here and looked up; the library's model encodes the new ones. All else is the library's."""

    def __init__(self, library):
        self.library = library
        self.token = byte_level_tokens(library)
        self.lengths = lengths(self.token)
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.model = type(library)(library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # which no mapped byte is
        of = {b: c for c, b in byte_level().items()}
        # no plain character is a zero, so it can stand between pieces
        self.mapped = {b: of[b] if b else " " for b in range(256)}
        self.pieces = Memo(lambda new: [(*self._encoded(new), np.ones(len(new), bool))], 1, PIECES)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = "\0".join(pieces).encode()
        found = self.model.encode_batch([raw.decode("latin-1").translate(self.mapped)], add_special_tokens=False)[0]
        ids = np.array(found.ids)
        gaps = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 0), len(raw))
        return ids, _sizes(self.lengths[ids], gaps - np.arange(len(gaps)))

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special)

    def __call__(self, units: list[Unit]) -> Encoded:
        texts = [" " + u if type(u) is str else u[0] for u in units]
        # white space apart, a plain character at an end keeps pieces from reaching over it
        safe = [type(u) is str and u != "" and u[0] > " " and u[-1] > " " for u in units]
        cut: list[list[str]] = []
        counts = np.zeros(len(units), np.int64)
        plain = np.zeros(len(units), bool)
        together = np.flatnonzero(safe)
        for at in range(0, len(together), TOGETHER):
            run = together[at : at + TOGETHER]
            joined = "".join([texts[k] for k in run])
            if self._plain(joined):  # pieces end where units do
                found = _PIECE.findall(joined)
                ends = np.cumsum([len(texts[k]) for k in run])
                plain[run], counts[run] = True, _sizes(np.fromiter(map(len, found), np.int64, len(found)), ends)
                cut.append(found)
        for k in np.flatnonzero(~plain):
            if self._plain(texts[k]):
                cut.append(found := _PIECE.findall(texts[k]))
                plain[k], counts[k], safe[k] = True, len(found), False
        order = [*together[plain[together] & np.array(safe, bool)[together]].tolist(), *np.flatnonzero(plain & ~np.array(safe, bool)).tolist()]
        order = np.array(order, np.int64)
        ids, n = self.pieces.gather(0, self.pieces.look_up(list(chain.from_iterable(cut))))
        rest = [texts[k] for k in np.flatnonzero(~plain)]
        others = [e.ids for e in self.library.encode_batch(rest, add_special_tokens=False)]
        sizes, good = np.zeros(len(units), np.int64), np.ones(len(units), bool)
        sizes[order] = per_text(n, counts[order].tolist())
        sizes[~plain] = list(map(len, others))
        good[~plain] = [self.keeps(t, o) for t, o in zip(rest, others)]
        return _in_order(order, sizes, ids, np.flatnonzero(~plain), others), sizes, good

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def keeps(self, text: str, ids: list[int]) -> bool:
        """Whether the tokens make up the text."""
        return b"".join(self.token.get(i, b"") for i in ids) == text.encode()


class Pieces:
    """Units by a sentencepiece model, which puts a space before a text. Many units are encoded as
    one text where no piece can join over their ends."""

    def __init__(self, library):
        self.library = library
        pieces = ((i, library.id_to_piece(i)) for i in range(library.get_piece_size()))
        self.token = {i: bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.lengths = lengths(self.token)

    def __call__(self, units: list[Unit]) -> Encoded:
        joined = [k for k, u in enumerate(units) if isinstance(u, str) and u and _safe(u[0]) and _safe(u[-1])]
        alone, sizes, ids = set(range(len(units))).difference(joined), {}, {}
        runs = [joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)]
        texts = [" ".join([units[k] for k in run]) for run in runs]
        for run, text, found in zip(runs, texts, self.library.encode(texts, num_threads=1)):
            if self.keeps(f" {text}", found):
                found = np.array(found)
                size = _sizes(self.lengths[found], np.cumsum([1 + len(units[k].encode()) for k in run]))
                sizes.update(zip(run, size.tolist()))
                ids.update(zip(run, np.split(found, np.cumsum(size)[:-1])))
            else:
                alone.update(run)
        single = sorted(alone)
        good = np.ones(len(units), bool)
        for k, found in zip(single, self.library.encode([whole(units[k])[1:] for k in single], num_threads=1)):
            ids[k], sizes[k], good[k] = np.array(found, np.int64), len(found), self.keeps(whole(units[k]), found)
        every = range(len(units))
        return np.concatenate([ids[k] for k in every]), np.array([sizes[k] for k in every], np.int64), good

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text[1:])

    keeps = ByteLevel.keeps


def _safe(char: str) -> bool:
    """Whether a cut beside a character is safe, as in the patterns above."""
    return "!" <= char <= "~" or char.isalnum()


def _in_order(order: np.ndarray, sizes: np.ndarray, ids: np.ndarray, rest: np.ndarray, others: list[list[int]]) -> np.ndarray:
    """Ids of all units one after another: those of `order` lie in `ids`, those of `rest` in `others`."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int64)
    for where, values in ((order, ids), (rest, np.fromiter(chain.from_iterable(others), np.int64))):
        size = sizes[where]
        out[np.arange(len(values)) + np.repeat(starts[where] - (np.cumsum(size) - size), size)] = values
    return out


def _sizes(length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many tokens, of some lengths, each of some strings has; tokens end where strings do."""
    have = np.cumsum(length)
    at = np.searchsorted(have, ends)
    if (have[at] != ends).any():
        raise ValueError("a token reaches over the end of a piece")
    return np.diff(at + 1, prepend=0)


def lengths(token: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(token, default=0) + 1, np.int64)
    out[list(token)] = [len(t) for t in token.values()]
    return out


def byte_level() -> dict[str, int]:
    """The byte that every character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


def byte_level_tokens(library) -> dict[int, bytes]:
    """The bytes of every entry of a tokenizers library's byte-level vocabulary."""
    of = byte_level()
    entries = library.get_vocab()
    return {i: bytes(map(of.__getitem__, e)) for e, i in entries.items() if all(c in of for c in e)}


class Memo:
    """Ids of units (or pieces) on some sides. It is emptied when it holds more than `keep` of them,
    or too many ids of long ones."""

    def __init__(self, encode: Callable[[list[Unit]], list[Encoded]], sides: int = 1, keep: int | None = None):
        self.encode, self.sides, self.keep = encode, sides, keep
        self._clear()

    def _clear(self) -> None:
        self.known: dict[Unit, int] = {}
        self.full = False
        self.ids = [np.zeros(0, np.int32)] * self.sides
        self.sizes = [np.zeros(0, np.int32)] * self.sides
        self.good = np.ones(0, bool)

    def look_up(self, flat: list[Unit]) -> np.ndarray:
        """The numbers of units, valid until the next call."""
        if self.full:
            self._clear()
        new = list(set(flat) - self.known.keys())
        if new:
            good = np.ones(len(new), bool)
            for f, (ids, sizes, fine) in enumerate(self.encode(new)):
                self.ids[f] = np.concatenate([self.ids[f], ids.astype(np.int32)])
                self.sizes[f] = np.concatenate([self.sizes[f], sizes.astype(np.int32)])
                good &= fine
            self.good = np.concatenate([self.good, good])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            keep = self.keep or MEMO
            self.full = len(self.known) > keep or max(map(len, self.ids)) > LONG * keep
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def gather(self, f: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after another, and how many each has."""
        sizes = self.sizes[f].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        size = sizes[which]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - size), size)
        return self.ids[f][places].astype(np.int64), size


def per_text(sizes: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of unit sizes by text."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])])


def by_place(df: DataFrame) -> DataFrame:
    """df with columns named by their place, as functions on batches can't take every name."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))
