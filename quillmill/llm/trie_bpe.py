"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a batch form a trie.  A depth-first walk gives every node
one state, the last token of the BPE encoding of the prefix it stands for: among
the tokens that end there, the one compatible with the last token of the prefix
before it.  Two tokens are compatible if BPE leaves them as they are side by
side; an encoding whose neighbours all are is the encoding, so each prefix is
encoded once for all words that share it, and a word's ids are read by following
states back to the root.  The walk goes through the words in sorted order: what a
word shares with the one before it is the path that stays on the stack.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import KEPT, release, slices, trim
from .tokens import PieceEncoder, pieces


class TrieBpe:
    """Model, pre-tokenizer and vocabulary of a tokenizer file with byte-level symbols and a word-end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.tok = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update((i, t) for t, i in self.special.items())
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = max(len(t.removesuffix(self.end)) if self.end else len(t) for t in self.vocab)
        self.fits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    # -- plain BPE, for pairs of tokens only

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return self.fits[key]

    def _whole(self, token: str) -> bool:
        if token not in self.alone:
            self.alone[token] = self._merge(self._symbols(token)) == [token]
        return self.alone[token]

    def _last(self, text: str, upto: int, mark: str, states: list) -> tuple[str, int]:
        """State of the prefix text[:upto] (its last symbol with ``mark``): last token and where it begins."""
        vocab = self.vocab
        for begin in range(max(0, upto - self.longest), upto):
            token = text[begin:upto] + mark
            if token in vocab and (self._compatible(states[begin][0], token) if begin else self._whole(token)):
                return token, begin
        raise ValueError(f"no token ends {text[:upto]!r}")

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of each distinct pre-token, walking their trie once."""
        out, states, before = {}, [("", 0)], ""
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            shared = min(shared, len(states) - 1)
            del states[shared + 1 :]
            for upto in range(shared + 1, len(word)):
                states.append(self._last(word, upto, "", states))
            token, at = self._last(word, len(word), self.end, states)
            ids = [self.vocab[token]]
            while at:
                token, at = states[at]
                ids.append(self.vocab[token])
            out[word] = ids[::-1]
            before = word
        return out

    def split(self, piece: str) -> list:
        """A white-space piece as pre-tokens, special tokens as their ids."""
        if piece.isascii() and piece.isalpha() and piece.islower():
            return [piece]
        if self.cut_special and "<" in piece and self.cut_special.search(piece):
            return [y for x in self.cut_special.split(piece) if x for y in ([self.special[x]] if x in self.special else self._pre(x))]
        return self._pre(piece)

    def _pre(self, text: str) -> list[str]:
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def encode_many(self, some: list[str]) -> list[list[int]]:
        cut = [self.split(x) for x in some]
        ids = self.encode_words(w for x in cut for w in x if isinstance(w, str))
        return [[i for w in x for i in (ids[w] if isinstance(w, str) else (w,))] for x in cut]

    def decode(self, ids) -> str:
        """As the library with no decoder set: known tokens' names joined by one space."""
        return " ".join([self.names[i] for i in ids if i in self.names])


_loaded: dict[str, tuple[TrieBpe, PieceEncoder]] = {}
KEPT.append(_loaded)


def loaded(path: str) -> tuple[TrieBpe, PieceEncoder]:
    """This worker's encoder, kept for its next task; what other operators kept goes."""
    release(_loaded)
    if path not in _loaded:
        bpe = TrieBpe(path)
        _loaded[path] = bpe, PieceEncoder(bpe.encode_many)
    return _loaded[path]


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", keep_ids=False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with ``keep_ids``) for each row.

    Null texts count as empty: no ids, and the digests of nothing.  Rows that
    repeat are encoded each.  Other columns are ignored; no rows, no result.
    """

    def work(batches):
        bpe, coder = loaded(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                coded, first = pieces(texts.slice(a, b - a))
                found = coder.lookup(coded.dictionary.to_pylist())
                shown = [bpe.decode(np.frombuffer(x, "<u4").tolist()).encode() for x in found]
                index, sha, back, count, ids = coded.indices.to_numpy(), [], [], [], []
                for i in range(b - a):
                    at = index[first[i] : first[i + 1]].tolist()
                    raw = b"".join([found[j] for j in at])
                    sha.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(b" ".join([shown[j] for j in at if shown[j]])).hexdigest())
                    count.append(len(raw) // 4)
                    ids.append(raw)
                arrays = [batch.column("doc_id").slice(a, b - a), pa.array(count, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                trim()

    from pyspark.sql import functions as F

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
