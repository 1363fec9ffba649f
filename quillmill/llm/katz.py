"""Katz backoff over words, pairs and triples, with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = d(r) * r / below(h)         for h w seen r times in training, d by its order
             = alpha(h) * P(w | h')        else; h' is h without its first word
             = P(w | h')                   where h was never seen
    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))

``below(h)`` is how often h was seen, and alpha(h) makes all words and the unknown
one sum to 1; where nothing after h was discounted, one count more is set aside for
the unseen.  Before a text stand two marks of its beginning; its end is a word.

Words, pairs and triples are counted over all training texts by hash buckets
(``exchange``), one exchange an order.  The first pass keeps the text as words' numbers,
a file for each block, which the later passes read.  A block sends the distinct grams it holds, with
their counts and those of the next shorter gram; a bucket, which holds all that
follows a context, adds them up and answers counts, and what the weight of a context
with an unseen word is made of, in whole numbers.  The grams of very frequent contexts
are dealt by the gram instead; those few contexts' sums go through the driver.
Answers lie in the shared folder, a file for each block and order; each token is
then evaluated by recursion over the orders.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mix64, new_key, read_file, release, temporary_path, trim, word_hashes, write_file
from .exchange import ROWS, answer, ask, bucket_of, deliver, delivered, in_blocks, pack, row_batch, runs_of, text_buckets, unpack

ORDER = 3
#: Counts up to so many are discounted.
K = 5
HELD_OUT, OF = 1, 5
#: Contexts more frequent than one token in so many (and than so many times) are dealt by gram: at most so many, whatever the input.
HOT, LEAST_HOT = 4096, 1000
#: Buckets for each that ``exchange`` would have: grams of three words take more room.
SPLIT = 2
_END = np.uint64(0x6A09E667F3BCC909)  # the end of a text, a word of its own
_BEGIN = 1  # id of the beginning as a context; words' ids start at 2
_WORD = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def held_out(ids: list) -> np.ndarray:
    """crc32 of the id as text (null: the empty text), modulo 5, is 1."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % OF == HELD_OUT for x in ids], bool)


def _stream(ids: pa.Array, texts: pa.Array, key: int):
    """Distinct words of a block sorted, each token's place among them, each text's first token (n+1 values), and held-out marks."""
    h, first = word_hashes(texts, lower=True, key=key)
    count = len(texts)
    ends = first[1:] + np.arange(count)
    tokens = np.full(len(h) + count, _END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = h
    words, place = np.unique(tokens, return_inverse=True)
    return words, place, np.concatenate([[0], ends + 1]), held_out(ids.to_pylist())


def discounts(types: list[int]) -> np.ndarray:
    """d(1..K) from the numbers of grams of an order seen 1, 2, ..., K + 1 times.

    Katz's formula where it lies in (0, 1); where the counts don't allow it (small
    corpora), the absolute discount 1 - D / r with D = n1 / (n1 + 2 n2).
    """
    n = np.array([0, *types], float)
    d_abs = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    out = []
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (star - tail) / (1 - tail) if tail < 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - d_abs / r)
    return np.array(out)


# ------------------------------------------------------- sums of a context

#: For each context: how many words follow it 1 to K times; of the shorter grams of all that follow, how many were
#: seen 1 to K times; the sum of those seen more often; and how many words follow.
SUMS = 2 * K + 2


def sums_of(where: np.ndarray, n: int, seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """(SUMS, n) whole numbers over grams seen in training, each with its context's place."""
    rows = [np.bincount(where[x == r], minlength=n) for x in (seen, lower) for r in range(1, K + 1)]
    rows.append(np.bincount(where, np.where(lower > K, lower, 0), n))
    rows.append(np.bincount(where, minlength=n))
    return np.array(rows).astype(np.int64)


class Model:
    """What the driver knows after each order: sums, folders, discounts and at most ``HOT`` contexts' sums.

    ``listed`` names the blocks whose tokens are saved in the folder ``blocks``.
    """

    def __init__(self, n: int, key: int):
        self.n, self.key = n, key
        self.total = self.distinct = self.texts = 0
        self.folders, self.d, self.hot = {}, {}, {}
        self.limit, self.blocks, self.listed = 0, "", None

    def __getstate__(self):  # tasks don't need the table
        return {**self.__dict__, "listed": None}

    @property
    def z(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def _by_digits(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``order`` sorted stably by ``key[order]``, 16 bits at a time, which numpy sorts by radix."""
    for shift in range(0, int(key.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
    return order


class Grams:
    """The distinct grams of one order in a block, by context, then word; and where they are asked."""

    def __init__(self, model: Model, order: int, block: Block, left: np.ndarray, keys: np.ndarray, counts: np.ndarray, shorter: np.ndarray, lower: np.ndarray):
        """``left``: for each token the number of its context; ``keys`` and ``counts``: what contexts of these numbers are called, ascending, and how often they were seen.

        ``shorter``: each token's place among the shorter grams; ``lower``: how often these were seen.
        """
        by = _by_digits(block.by_word, left)
        l, w = left[by], block.place[by]
        other = np.ones(len(by), bool)
        other[1:] = l[1:] != l[:-1]
        new = other.copy()
        new[1:] |= w[1:] != w[:-1]
        self.at = np.empty(len(by), np.int32)
        self.at[by] = np.cumsum(new, dtype=np.int32) - 1
        self.order, self.word, self.shorter = order, block.ids[w[new]], shorter[by[new]]
        self.lower = lower[self.shorter]
        self.of = np.cumsum(other[new], dtype=np.int32) - 1
        self.context, self.count = keys[l[other]], counts[l[other]]
        self.hot = self.count > model.limit
        own = bucket_of(mix64(self.context), model.n)[self.of]
        if self.hot.any():
            some = np.flatnonzero(self.hot[self.of])
            own[some] = model.n + bucket_of(mix64(self.context[self.of[some]] * np.uint64(0x9E3779B97F4A7C15) + self.word[some]), model.n)
        self.by = _by_digits(np.arange(len(own)), own)
        self.runs = list(runs_of(own[self.by]))

    def ask(self, block: int, trained: np.ndarray):
        seen = np.bincount(self.at[trained], minlength=len(self.word))[self.by]
        context, word, lower = self.context[self.of[self.by]], self.word[self.by], self.lower[self.by]
        for i, a, b in self.runs:
            yield 0, block, i, pack(context[a:b], word[a:b], seen[a:b], lower[a:b]), 0, 0

    def hear(self, model: Model, block: int, shorter: "Grams | None"):
        """Sets each gram's training count ``seen``, and each context's ``below`` and ``alpha``."""
        told = delivered(model.folders[self.order], block, [i for i, _, _ in self.runs])
        marks, of, n = np.zeros(len(self.word), np.uint64), self.of[self.by], len(self.context)
        known = self.count > 0
        few, sums, asked = np.zeros(n, bool), np.zeros((SUMS, n), np.int64), np.zeros(n, bool)
        for i, a, b in self.runs:
            marks[a:b], *some = unpack(told[i])
            if i >= model.n:
                marks[a:b] <<= np.uint64(1)
                continue
            new = of[a:b][marks[a:b] < 2]
            new = new[known[new]]
            if len(new):
                new = new[np.concatenate([[True], new[1:] != new[:-1]])]
                sums[:, new], asked[new] = np.array(some).reshape(SUMS, -1), True
        few[of] = marks & np.uint64(1)
        self.seen = np.empty(len(self.word), np.int64)
        self.seen[self.by] = marks >> np.uint64(1)
        if self.hot.any():
            contexts, totals = model.hot[self.order]
            sums[:, self.hot] = totals[:, np.searchsorted(contexts, self.context[self.hot])]
            few[self.hot], asked[self.hot] = sums[:K, self.hot].any(0), True
        # A context of which nothing was discounted sets one count aside; one never seen leaves all to the shorter model.
        self.below = np.where(known, self.count + ~few, 1)
        self.alpha = np.ones(len(self.context))
        self.alpha[asked] = self._alpha(model, asked, sums[:, asked], shorter)

    def _alpha(self, model: Model, which: np.ndarray, sums: np.ndarray, shorter: "Grams | None") -> np.ndarray:
        r = np.arange(1, K + 1)[:, None]
        d = model.d[self.order]
        free = (sums[:K] * r * (1 - d[:, None])).sum(0) + (self.below[which] - self.count[which])
        if shorter is None:  # the words' own model: (c + 0.5) / z each
            lower = ((sums[K : 2 * K] * r).sum(0) + sums[2 * K] + 0.5 * sums[2 * K + 1]) / model.z
        else:
            last = np.searchsorted(shorter.context, self.context[which] & _WORD)
            lower = ((sums[K : 2 * K] * r * model.d[self.order - 1][:, None]).sum(0) + sums[2 * K]) / shorter.below[last]
        return free / self.below[which] / (1 - lower)

    def log_probability(self, model: Model, shorter: np.ndarray) -> np.ndarray:
        """log10 P of each gram's last word, from that of the shorter grams."""
        d = np.concatenate([[1.0], model.d[self.order], [1.0]])[np.minimum(self.seen, K + 1)]
        with np.errstate(divide="ignore"):
            own = np.log10(d * self.seen / self.below[self.of])
        return np.where(self.seen > 0, own, np.log10(self.alpha)[self.of] + shorter[self.shorter])


class Block:
    """A block's tokens as places among its words, by ascending id; its words' ids and counts; its documents."""

    def __init__(self, docs: pa.Array, length: np.ndarray, place: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.docs, self.place, self.ids, self.counts = docs, place.astype(np.int32), ids, counts.astype(np.int64)
        self.length, self.first = length.astype(np.int64), np.cumsum(length.astype(np.int64)) - length.astype(np.int64)
        self.held = held_out(docs.to_pylist())
        self.trained = np.repeat(~self.held, self.length)

    @staticmethod
    def save(path: str, docs: pa.Array, length: np.ndarray, place: np.ndarray, runs: list) -> None:
        """Tokens as places among the block's words in the order of their hashes; ``runs``: those words by bucket."""
        null, ids = np.array(docs.is_null()), docs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        write_file(path, pack(null, ids, length, place, np.array([i for i, _, _ in runs]), np.array([b for _, _, b in runs])))

    @classmethod
    def load(cls, model: Model, block: int) -> "Block":
        null, docs, length, place, buckets, ends = unpack(read_file(f"{model.blocks}/{block:016x}"))
        ends = ends.astype(np.int64).tolist()
        counts, ids, told = np.zeros(ends[-1], np.uint64), np.zeros(ends[-1], np.uint64), delivered(model.folders[1], block, buckets.tolist())
        for i, a, b in zip(buckets.tolist(), [0, *ends], ends):
            counts[a:b], ids[a:b] = unpack(told[i])
        order = np.argsort(ids)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        return cls(pa.array(docs.view(np.int64), mask=null.astype(bool)), length, rank[place.astype(np.int32)], ids[order], counts[order])

    def grams(self, model: Model, block: int, order: int) -> list[Grams]:
        """Grams of two words up to ``order``; all but the last have heard their answers."""
        self.by_word = _by_digits(np.arange(len(self.place)), self.place)
        left = np.empty(len(self.place), np.int32)
        # Context 0 is the text's beginning; the others follow in the order of words or shorter grams.
        left[1:], left[self.first] = self.place[:-1] + 1, 0
        keys, counts, shorter, lower, out = np.concatenate([[np.uint64(_BEGIN)], self.ids]), np.concatenate([[model.texts], self.counts]), self.place, self.counts, []
        for k in range(2, order + 1):
            out.append(Grams(model, k, self, left, keys, counts, shorter, lower))
            if k < order:
                now = out[-1]
                now.hear(model, block, out[-2] if k > 2 else None)
                left[1:], left[self.first] = now.at[:-1] + 1, 0
                keys = np.concatenate([[np.uint64(_BEGIN << 32 | _BEGIN)], now.context[now.of] << _32 | now.word])
                counts, shorter, lower = np.concatenate([[model.texts], now.seen]), now.at, now.seen
        return out


def _merge_grams(model: Model, order: int):
    def merge(bucket, rows):
        """Adds up the grams of the bucket's contexts and answers every block."""
        parts = [unpack(r[3]) for r in rows]
        context, word, seen, lower = (np.concatenate([x[i] for x in parts]) for i in range(4))
        contexts, where = np.unique(context, return_inverse=True)
        code = where.astype(np.uint64) << _32 | word
        by = np.argsort(code)
        code = code[by]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        at = np.flatnonzero(new)
        place = np.empty(len(code), np.int64)
        place[by] = np.cumsum(new) - 1
        total, lower = np.add.reduceat(seen[by].astype(np.int64), at), lower[by[at]].astype(np.int64)
        where = (code[at] >> _32).astype(np.int64)
        some = total > 0
        sums = sums_of(where[some], len(contexts), total[some], lower[some])
        hot = bucket >= model.n
        few, followed = sums[:K].any(0), sums[-1] > 0
        out = [(3, -1, bucket, b"", r, int(sums[r - 1].sum())) for r in range(1, K + 1)]
        out.append((3, -1, bucket, b"", K + 1, int((total == K + 1).sum())))
        if hot:
            out.append((4, -1, bucket, pack(contexts, *sums.astype(np.uint64)), 0, 0))
        begin = 0
        for row, x in zip(rows, parts):
            mine = place[begin : begin + len(x[0])]
            begin += len(mine)
            r, of = total[mine], where[mine]
            if hot:
                out.append((0, row[1], bucket, pack(r.astype(np.uint64)), 0, 0))
                continue
            wanted = np.unique(of[(r == 0) & followed[of]])
            out.append((0, row[1], bucket, pack((r * 2 + few[of]).astype(np.uint64), *sums[:, wanted].astype(np.uint64)), 0, 0))
        return out

    return merge


def _hot_sums(stats: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts dealt by gram, sorted, and their sums over all buckets: at most ``HOT`` contexts, added up in tasks first."""

    def add(batches):
        yield row_batch([(4, -1, 0, pack(*_added([x for b in batches for x in b.column("payload").to_pylist()])), 0, 0)])

    rows = stats.filter("kind = 4").repartition(max(1, math.isqrt(n))).mapInArrow(add, ROWS)
    contexts, *sums = _added([r["payload"] for r in rows.toLocalIterator()])
    return contexts, np.array(sums).astype(np.int64)


def _added(blobs: list[bytes]) -> list[np.ndarray]:
    parts = [unpack(x) for x in blobs]
    if not parts:
        return [np.zeros(0, np.uint64)] * (SUMS + 1)
    contexts, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    out = [np.zeros(len(contexts), np.uint64) for _ in range(SUMS)]
    for i, total in enumerate(out):
        np.add.at(total, place, np.concatenate([x[i + 1] for x in parts]))
    return [contexts, *out]


def _fit(source: DataFrame, order: int) -> Model:
    """Counts words, then grams order by order; after each, its answers lie in the shared folder."""
    n = SPLIT * text_buckets(source, "text")[0]
    model = Model(n, new_key())
    model.blocks = temporary_path(source.sparkSession, "tokens")

    def ask_words(block, ids, texts):
        words, place, first, held = _stream(ids, texts, model.key)
        trained = np.repeat(~held, np.diff(first))
        counts = np.bincount(place[trained], minlength=len(words)).astype(np.uint64)
        runs = list(runs_of(bucket_of(words, n)))
        Block.save(f"{model.blocks}/{block:016x}", ids, np.diff(first), place, runs)
        rows = [(0, block, i, pack(words[a:b], counts[a:b]), 0, 0) for i, a, b in runs]
        return [*rows, (2, -1, block % n, b"", block, int((~held).sum()))]

    def merge_words(bucket, rows):
        out = [r for r in rows if r[0] == 2]
        rows = [r for r in rows if r[0] == 0]
        if not rows:
            return out
        parts = [unpack(r[3]) for r in rows]
        words, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([x[1] for x in parts]).astype(np.float64), len(words)).astype(np.uint64)
        rank = np.empty(len(words), np.uint64)
        rank[np.lexsort((words, counts))[::-1]] = np.arange(len(words), dtype=np.uint64)
        ids = rank * np.uint64(n) + np.uint64(bucket + 2)  # frequent words get small ids, which pack well
        if len(ids) and int(ids.max()) >= 1 << 32:
            raise OverflowError("over 2^32 words: pairs no longer fit 64 bits")
        out.append((1, -1, bucket, b"", int(counts.sum()), int((counts > 0).sum())))
        at = 0
        for row, x in zip(rows, parts):
            here = place[at : at + len(x[0])]
            at += len(here)
            out.append((0, row[1], bucket, pack(counts[here], ids[here]), 0, 0))
        return out

    told = deliver(answer(ask(source, ask_words), merge_words, n), "words")
    model.folders[1] = told.folder
    model.listed = told.stats.filter("kind = 2").select(F.col("a").alias("block"))
    sums = {r["kind"]: r for r in told.stats.groupBy("kind").agg(F.sum(F.when(F.col("kind") == 1, F.col("a"))).alias("a"), F.sum("b").alias("b")).collect()}  # two rows
    if 1 in sums:
        model.total, model.distinct = int(sums[1]["a"]), int(sums[1]["b"])
    model.texts = int(sums[2]["b"]) if 2 in sums else 0
    model.limit = max(LEAST_HOT, model.total // HOT)
    for now in range(2, order + 1):
        asked = _each_block(model, ROWS, lambda block, now=now: row_batch(_asked(model, block, now)))
        told = deliver(answer(asked, _merge_grams(model, now), n), f"grams-{now}")
        types = {r["a"]: r["s"] for r in told.stats.filter("kind = 3").groupBy("a").agg(F.sum("b").alias("s")).collect()}  # K + 1 rows
        model.folders[now], model.d[now], model.hot[now] = told.folder, discounts([types.get(r, 0) or 0 for r in range(1, K + 2)]), _hot_sums(told.stats, n)
    return model


def _asked(model: Model, block: int, order: int) -> list[tuple]:
    some = Block.load(model, block)
    return list(some.grams(model, block, order)[-1].ask(block, some.trained))


def _each_block(model: Model, schema: str, make) -> DataFrame:
    """``make(block)`` for every saved block: what it needs of the text lies in the block's file."""

    def work(batches):
        release()
        for batch in batches:
            for block in batch.column("block").to_pylist():
                yield make(block)
                trim()

    return model.listed.repartition(2 * model.n, "block").mapInArrow(work, schema)


def score(docs: DataFrame, *, id_col="doc_id", text_col="text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Null and empty texts are the end alone.  Rows that repeat count, and are
    scored, each time; null ids count as the empty text for ``held_out``.  With no
    training text all words are unknown.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.  ``order`` is 2 or 3: a pair of
    32-bit word ids is a context of 64 bits.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    model = _fit(in_blocks(docs, id_col, text_col), order)

    def scored(block: int) -> pa.RecordBatch:
        some = Block.load(model, block)
        grams = some.grams(model, block, order)
        grams[-1].hear(model, block, grams[-2] if order > 2 else None)
        base = np.log10((some.counts + 0.5) / model.z)
        logp = base
        for one in grams:
            logp = one.log_probability(model, logp)
        sums = [np.add.reduceat(x, some.first) for x in ((some.counts > 0).astype(np.int64)[some.place], base[some.place], logp[grams[-1].at])]
        arrays = [some.docs, pa.array(some.held), pa.array(some.length), pa.array(sums[0]), pa.array(np.full(len(some.length), model.total, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _each_block(model, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", scored)
