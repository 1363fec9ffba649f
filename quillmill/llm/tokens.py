"""Texts to token ids, one encoding for each distinct piece of text.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins across
it, so a text's ids are those of its white-space pieces one after the other.
Each batch is cut into pieces with Arrow, only distinct pieces not met before
are encoded, and ids are put together with numpy.
"""

from __future__ import annotations

import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import KEPT, lowered, new_key, ragged, word_hashes

#: Pieces remembered by a worker; the memory is emptied when full.
REMEMBERED = 3_000_000
#: Pieces joined into one text for the library.
JOINED = 1000


def pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All pieces in order, dictionary-encoded, and each text's first piece (n+1 values).

    Two rewritings make more pieces equal without changing ids: A-Z are
    lower-cased (the tokenizer does it too, but after composing, so a letter
    before a character beyond ASCII, which may be a combining mark, stays; texts
    with the "<|" of its special tokens are left alone), and a letter is parted
    from a following . or , where the tokenizer always cuts.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.replace_substring_regex(lowered(texts, composing=True), r"([a-z])([.,])", r"\1 \2"))
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return parts.flatten().dictionary_encode(), offsets - offsets[0]


class PieceEncoder:
    """Ids of texts by way of ``encode_many``: list of pieces -> list of id sequences, or of their bytes.

    The ids of known pieces lie one after the other in ``pool``.  A piece is known
    by two 64-bit hashes under keys drawn for the worker: one is looked up in
    a sorted array, the other must agree.  Piece 0 is the empty one.
    """

    def __init__(self, encode_many):
        self.encode_many, self.keys = encode_many, (new_key(), new_key())
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.ends = array("I"), array("q", [0, 0])

    def _add(self, some: list[str]) -> None:
        for at in range(0, len(some), 20_000):
            for ids in self.encode_many(some[at : at + 20_000]):
                self.pool.frombytes(ids) if isinstance(ids, bytes) else self.pool.extend(ids)
                self.ends.append(len(self.pool))

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The number of each of these distinct pieces; those not known yet are encoded first."""
        (h, first), (check, _) = (word_hashes(names, False, key) for key in self.keys)
        out, single = np.zeros(len(names), np.int64), np.diff(first) == 1
        place = np.flatnonzero(single)
        h, check = h[first[place]], check[first[place]]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = (self.hashes[at] == h) & (self.checks[at] == check)
            out[place[hit]] = self.number[at[hit]]
            new = np.flatnonzero(~hit)
            if len(self.hashes) + len(new) > REMEMBERED:
                self.forget()
                new = np.arange(len(place))
        else:
            new = np.arange(len(place))
        if len(new):
            number = len(self.ends) - 1 + np.arange(len(new))
            self._add(names.take(pa.array(place[new])).to_pylist())
            out[place[new]] = number
            new = new[order := np.argsort(h[new])]
            at = np.searchsorted(self.hashes, h[new])
            self.hashes, self.checks, self.number = np.insert(self.hashes, at, h[new]), np.insert(self.checks, at, check[new]), np.insert(self.number, at, number[order])
        odd = [(i, x) for i, x in zip(np.flatnonzero(~single).tolist(), names.take(pa.array(np.flatnonzero(~single))).to_pylist()) if x]
        if odd:  # white space alone, or within: not a piece of a text
            out[[i for i, _ in odd]] = len(self.ends) - 1 + np.arange(len(odd))
            self._add([x for _, x in odd])
        return out

    def lookup(self, names: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian bytes."""
        at, raw, ends = self.numbers(pa.array(names, pa.large_string())), np.array(self.pool, "<u4").tobytes(), np.array(self.ends)
        return [raw[4 * a : 4 * b] for a, b in zip(ends[at].tolist(), ends[at + 1].tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and each text's first id (n+1 values)."""
        coded, first = pieces(texts)
        number = self.numbers(coded.dictionary)
        if not len(number):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        pool, ends = np.frombuffer(self.pool, np.uint32) if len(self.pool) else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        number = number[coded.indices.to_numpy()]
        start, length = ends[number], ends[number + 1] - ends[number]
        ids = pool[ragged(start, length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[first]


_encoders: dict[str, PieceEncoder] = {}
KEPT.append(_encoders)


def _ends_of_words(tok) -> np.ndarray | None:
    """Whether each id ends a pre-token, if the tokenizer marks that by a suffix; else None."""
    suffix = getattr(tok.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
    for token, number in tok.get_vocab(with_added_tokens=False).items():
        ends[number] = token.endswith(suffix)
    return ends


def _plain(piece: str) -> bool:
    """Letters below U+0250 alone, none of which composes or falls apart: one pre-token, whatever stands beside it."""
    return piece.isalpha() and (piece.isascii() or (max(piece) < "\u0250" and "\u0130" not in piece))


def _joined(tok):
    """Encodes pieces many at a time.

    Pieces of plain letters are one pre-token each, so they are joined by
    spaces, which the tokenizer drops, and parted by the mark that ends
    a pre-token.  Between others goes a special token: the library cuts texts there
    before anything else, so each piece is encoded as if alone.  Pieces
    that may hold such a token themselves are encoded one by one.
    """
    fit = [(x.content, number) for number, x in tok.get_added_tokens_decoder().items() if x.content.startswith("<|") and not (x.normalized or x.single_word or x.lstrip or x.rstrip)]
    word_end = _ends_of_words(tok)

    def joined(some: list[str], mark: str) -> np.ndarray:
        texts = [mark.join([*some[i : i + JOINED], ""]) for i in range(0, len(some), JOINED)]
        return np.array(array("I", chain.from_iterable(e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False))), "<u4")

    def parted(ids: np.ndarray, ends: np.ndarray, skipped: int) -> list[bytes]:
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *[x + skipped for x in ends]], ends)]

    def encode_many(some: list[str]) -> list:
        if not fit or any("<|" in x for x in some):
            return [e.ids for e in tok.encode_batch_fast(some, add_special_tokens=False)]
        plain = [i for i, x in enumerate(some) if word_end is not None and _plain(x)]
        out: list = [None] * len(some)
        if plain:
            ids = joined([some[i] for i in plain], " ")
            ends = np.flatnonzero(word_end[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                for i, x in zip(plain, parted(ids, ends, 0)):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            mark, number = fit[0]
            ids = joined([some[i] for i in rest], mark)
            for i, x in zip(rest, parted(ids, np.flatnonzero(ids == number), 1)):
                out[i] = x
        return out

    return encode_many


def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's ids, special tokens not added; kept for the worker's life."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _encoders[path] = PieceEncoder(_joined(tok))
    return _encoders[path]
