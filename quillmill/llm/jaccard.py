"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

1. Shingle sets are sorted arrays of 64-bit hashes under a key drawn for the run,
   so that no words can be chosen to collide; for two sets of 1,000 shingles a
   false common one has a chance of about 10^-12.  The corpus tells every
   block in how many texts each shingle stands, as a class (``exchange``).
2. Two sets that link share a shingle among the first ``n - ceil(0.75 n) + 1`` of
   each, in any one order; rarest first, most of those stand in one text and
   drop out.  What remains is keyed by shingle and size band; sets of like
   size that share a key are candidates.  Equal sets go on as one.
3. Candidates' groups (components over keys) are tiles: the sets of a tile, by
   size, are compared through bitmaps whose bit counts bound the intersection
   from above, then exactly.  Sets already in one class aren't compared again.
4. A group too large for a tile is dealt out by a hash; classes' first sets meet
   again, and what is still apart is compared tile by tile, so no link is lost.
5. Counting links compares a group's sets once more, each two of like size, for a
   count needs them all: tiles of one size band meet each other and those of the
   next band.  Only counts leave a tile; equal sets are counted by their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import FIXED_KEY, discard, mix64, new_key, ragged, stage, word_hashes
from .components import components
from .exchange import answer, ask, blocks, bucket_of, deliver, delivered, in_blocks, pack, runs_of, text_buckets, unpack

WORDS = 5
#: A set of n and a larger one link only if the ratio of their sizes is 0.75 or more; a band is a little wider.
BAND = math.log(4 / 3) + 1e-9
#: A tile's most sets and shingles.
TILE_SETS, TILE_SHINGLES = 500, 1_000_000
#: Key of rows without an id; ids are one less as keys, so that none meets it.
_NULL = (1 << 63) - 1


def shingles(texts: pa.Array, k: int = WORDS, key: int = FIXED_KEY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct shingles, sorted within each text, and each text's first (n+1 values)."""
    h, first = word_hashes(texts, lower=True, key=key)
    words = np.diff(first)
    full = np.maximum(words - k + 1, 0)
    counts = np.where(words >= k, full, (words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(words)), counts)
    start = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(text))
    short = words[text] < k
    out = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            at = start + j
            inside = ~short | (j < words[text])
            value = h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else out
            out = np.where(inside, out * np.uint64(0xA0761D6478BD642F) + value + np.uint64(1), out)
        out = mix64(out + np.where(short, words[text], 0).astype(np.uint64))
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[new], text[new]
    return out, np.searchsorted(text, np.arange(len(words) + 1))


def _distinct(h: np.ndarray):
    """Distinct values sorted, their counts, and each value's place."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], np.diff(np.append(at, len(s))), place


def _sets(source: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (a digest of the set), and for candidates tokens (prefix shingles met elsewhere) and the set."""
    (n_buckets, size), key = text_buckets(source, "text"), new_key()
    # Ranks go by as many bits as leave few clashes; one only makes two shingles look more frequent.
    cut = np.uint64(64 - min(64, max(40, int(size // 4).bit_length() + 7)))

    def questions(block, ids, texts):
        p, counts, _ = _distinct(shingles(texts, key=key)[0] >> cut)
        return [(0, block, i, pack(p[a:b], counts[a:b].astype(np.uint64)), 0, 0) for i, a, b in runs_of(bucket_of(p << cut, n_buckets))]

    def merge(bucket, rows):
        parts = [unpack(r[3]) for r in rows]
        p, weight = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        _, _, place = _distinct(p)
        texts = np.bincount(place, weight.astype(np.float64))[place]
        rank = np.where(texts < 2, 0, np.floor(np.log2(np.maximum(texts, 2)))).astype(np.uint64)
        out, at = [], 0
        for row, x in zip(rows, parts):
            out.append((0, row[1], bucket, pack(rank[at : at + len(x[0])]), 0, 0))
            at += len(x[0])
        return out

    told = deliver(answer(ask(source, questions), merge, n_buckets), "ranks")
    folder = told.folder

    def work(batches):
        for block, ids, texts in blocks(batches):
            h, first = shingles(texts, key=key)
            p, _, place = _distinct(h >> cut)
            rank, runs = np.zeros(len(p), np.uint8), list(runs_of(bucket_of(p << cut, n_buckets)))
            found = delivered(folder, block, [i for i, _, _ in runs])
            for i, a, b in runs:
                rank[a:b] = unpack(found[i])[0]
            rank, size = rank[place], np.diff(first)
            text = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, rank, text))
            nth = np.arange(len(h)) - first[:-1][text]
            need = size - (3 * size + 3) // 4 + 1
            use = (nth < need[text]) & (rank[order] > 0)
            tokens, holder = h[order][use], text[use]
            ends = np.searchsorted(holder, np.arange(len(size) + 1))
            m = mix64(h)
            s1 = np.concatenate([[np.uint64(0)], np.cumsum(m, dtype=np.uint64)])
            s2 = np.concatenate([[np.uint64(0)], np.cumsum(mix64(m ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
            whole = h.astype("<u8").tobytes()
            arrays = [whole[8 * a : 8 * b] if ends[i + 1] > ends[i] else None for i, (a, b) in enumerate(zip(first, first[1:]))]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size.astype(np.int64)), pa.array((s1[first[1:]] - s1[first[:-1]]).view(np.int64)), pa.array((s2[first[1:]] - s2[first[:-1]]).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int64))), pa.array(arrays, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "tokens", "arr"],
            )

    sets = source.mapInArrow(work, "doc_id long, n long, s1 long, s2 long, tokens array<long>, arr binary")
    staged = stage(sets.withColumn("k", F.coalesce(F.col("doc_id") - 1, F.lit(_NULL))), "sets")
    told.drop()
    return staged


# -------------------------------------------------------------------- tiles

def _width(sizes: np.ndarray) -> int:
    """Bits of a signature for sets of these sizes, a power of two."""
    return min(max(64, 1 << int(4 * np.median(sizes)).bit_length()), 1 << 14)


def _bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Signatures of ``width`` bits, one set by each shingle."""
    out = np.zeros((len(sets), width // 64), np.uint64)
    for row, x in zip(out, sets):
        bit = x & np.uint64(width - 1)
        np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def links(left: list[np.ndarray], right: list[np.ndarray] | None, same: np.ndarray, other: np.ndarray | None = None):
    """Merge classes by verified links and yield (i, j) for each merge.

    Within ``left`` (``right`` None), or between both; ``same`` and ``other`` are the
    classes so far.  Sets of one class aren't compared.
    """
    inner = right is None
    right, other = (left, same) if inner else (right, other)
    size_l, size_r = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    if not len(size_l) or not len(size_r):
        return
    width = _width(size_r)
    sig_r = _bitmaps(right, width)
    sig_l = sig_r if inner else _bitmaps(left, width)
    order = np.argsort(size_r, kind="stable")
    sizes = size_r[order]
    for i in np.argsort(size_l, kind="stable") if inner else range(len(left)):
        a = int(size_l[i])
        lo, hi = np.searchsorted(sizes, -(-3 * a // 4), "left"), np.searchsorted(sizes, 4 * a // 3, "right")
        near = order[lo:hi]
        near = near[other[near] != same[i]]
        if not len(near):
            continue
        need = -(-3 * (a + size_r[near]) // 7)
        missing = np.bitwise_count(sig_l[i] & ~sig_r[near]).sum(1, dtype=np.int64)
        near = near[a - missing >= need]
        for j in near:
            if other[j] == same[i]:
                continue
            common = len(np.intersect1d(left[i], right[j], assume_unique=True))
            if 100 * common >= 75 * (a + len(right[j]) - common):
                yield int(i), int(j)
                old, new = max(same[i], other[j]), min(same[i], other[j])
                same[same == old] = new
                if not inner:
                    other[other == old] = new


def _tile(table: pa.Table) -> pa.Table:
    """(k, label) of a tile's sets; labels are the least id of a verified class."""
    ids = table.column("k").to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in table.column("arr").to_pylist()]
    label = (table.column("label") if "label" in table.column_names else table.column("k")).to_numpy().copy()
    for _ in links(sets, None, label):
        pass
    return pa.table({"k": ids, "label": label})


def _between(table: pa.Table) -> pa.Table:
    """Label pairs linked between the sets marked side 0 and side 1 of a tile."""
    side, label = table.column("side").to_numpy(), table.column("label").to_numpy().copy()
    sets = [np.frombuffer(x, "<u8") for x in table.column("arr").to_pylist()]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    left, right = label[a].copy(), label[b].copy()
    was_l, was_r = label[a].copy(), label[b].copy()
    pairs = {(int(was_l[i]), int(was_r[j])) for i, j in links([sets[x] for x in a], [sets[x] for x in b], left, right)}
    us, vs = zip(*sorted(pairs)) if pairs else ((), ())
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _relabel(frame: DataFrame, merged: DataFrame) -> DataFrame:
    """``label`` replaced by its component where ``merged`` has one."""
    merged = merged.select(F.col("id").alias("m_id"), "component")
    return frame.join(merged, frame.label == merged.m_id, "left").withColumn("label", F.coalesce("component", "label")).drop("m_id", "component")


def _verified(members: DataFrame) -> DataFrame:
    """(k, label) for candidates (k, n, arr, comp): classes by exact links."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    sizes = sizes.select(F.col("comp").alias("g"), F.ceil(F.greatest(F.col("c") / TILE_SETS, F.col("t") / TILE_SHINGLES)).cast("int").alias("tiles"))
    members = stage(members.join(sizes, F.col("comp") == F.col("g")).drop("g"), "members")
    tile = F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")
    labels = stage(members.withColumn("tile", tile).select("comp", "tile", "k", "arr").groupBy("comp", "tile").applyInArrow(_tile, "k long, label long"), "labels")
    large = members.filter("tiles > 1")
    if not large.take(1):
        discard(members)
        return labels
    # Groups of several tiles.  First, the first sets of classes meet, a tile's worth at a time.
    state = stage(large.join(labels, "k"), "large")
    for turn in range(8):
        heads = state.filter("k = label")
        sizes = heads.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
        sizes = sizes.select(F.col("comp").alias("g"), F.ceil(F.greatest(F.col("c") / TILE_SETS, F.col("t") / TILE_SHINGLES)).cast("int").alias("now"))
        dealt = heads.join(sizes, F.col("comp") == F.col("g")).withColumn("tile", F.pmod(F.xxhash64("k", F.lit(turn + 1)), F.col("now")).cast("int"))
        before, several = heads.count(), bool(dealt.filter("now > 1").take(1))
        met = dealt.select("comp", "tile", "k", "arr").groupBy("comp", "tile").applyInArrow(_tile, "k long, label long").filter("k <> label")
        met = stage(met, "met")
        state = _replaced(state, _relabel(state, met.select(F.col("k").alias("id"), F.col("label").alias("component"))), met)
        if state.filter("k = label").count() == before or not several:
            break
    # Then all sets outside a group's largest class meet all its sets, tile by tile.
    classes = state.groupBy("comp", "label").agg(F.count("*").alias("c"))
    most = classes.groupBy("comp").agg(F.max(F.struct("c", "label")).alias("x")).select(F.col("comp").alias("g"), F.col("x.label").alias("main"))
    state = _replaced(state, state.join(most, F.col("comp") == F.col("g")).drop("g"))
    rest = state.filter("label <> main")
    if rest.take(1):
        chunks = rest.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
        chunks = chunks.select(F.col("comp").alias("g"), F.ceil(F.greatest(F.col("c") / (TILE_SETS // 2), F.col("t") / (TILE_SHINGLES // 2))).cast("int").alias("chunks"))
        each = rest.join(chunks, F.col("comp") == F.col("g")).withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(99)), F.col("chunks")).cast("int"))
        each = each.select("comp", "chunk", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("side"), "label", "arr")
        every = state.join(chunks, F.col("comp") == F.col("g")).withColumn("tile", tile)
        every = every.select("comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "tile", F.lit(1).alias("side"), "label", "arr")
        found = each.unionByName(every).groupBy("comp", "chunk", "tile").applyInArrow(_between, "u long, v long")
        found = stage(found, "between")
        if found.take(1):
            state = _replaced(state, _relabel(state, components(found)), found)
    both = stage(labels.join(large.select("k"), "k", "left_anti").unionByName(state.select("k", "label")), "labels")
    discard(members, labels, state)
    return both


def _replaced(old: DataFrame, new: DataFrame, *used: DataFrame) -> DataFrame:
    """``new`` staged; ``old`` and what else it was made of deleted."""
    new = stage(new, "large")
    discard(old, *used)
    return new


# -------------------------------------------------------------- link counts

def degrees(sets: list[np.ndarray], weight: np.ndarray, other: np.ndarray, inner: bool) -> np.ndarray:
    """For each set the weights of the sets it links with, added up.

    With ``inner`` each two sets meet; else all sets that ``other`` marks meet all
    that it doesn't, and where there are only ones of a kind, none meet.  Bit counts bound the overlap first; what passes is intersected.
    """
    out = np.zeros(len(sets), np.int64)
    size = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((size, other))  # unmarked, then marked ones, each by size
    sizes, weight = size[order], weight[order]
    begin = 0 if inner else int((~other).sum())
    if begin == len(sets) or not len(sets):
        return out
    sig = _bitmaps([sets[x] for x in order], _width(size))
    # A shingle's place among the distinct ones makes an intersection a look-up.
    distinct, place = np.unique(np.concatenate([sets[x] for x in order]), return_inverse=True)
    first, held = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(distinct), bool)
    found = np.zeros(len(sets), np.int64)
    for i in range(len(sets) if inner else begin):
        a = int(sizes[i])
        lo, hi = np.searchsorted(sizes[begin:], (-(-3 * a // 4), 4 * a // 3 + 1)) + begin
        lo = max(lo, i + 1) if inner else lo
        near = np.arange(lo, hi)
        need = -(-3 * (a + sizes[lo:hi]) // 7)
        near = near[a - np.bitwise_count(sig[i] & ~sig[lo:hi]).sum(1, dtype=np.int64) >= need]
        if not len(near):
            continue
        held[place[first[i] : first[i + 1]]] = True
        hit = held[place[ragged(first[near], sizes[near])]] if 2 * len(near) < hi - lo else held[place[first[lo] : first[hi]]]
        total = np.concatenate([[0], np.cumsum(hit)])
        if len(total) - 1 == first[hi] - first[lo]:
            common = total[first[near + 1] - first[lo]] - total[first[near] - first[lo]]
        else:
            ends = np.cumsum(sizes[near])
            common = total[ends] - total[ends - sizes[near]]
        held[place[first[i] : first[i + 1]]] = False
        near = near[100 * common >= 75 * (a + sizes[near] - common)]
        found[i] += weight[near].sum()
        found[near] += weight[i]
    out[order] = found
    return out


def _degrees(table: pa.Table) -> pa.Table:
    """(n, s1, s2, links) of a task's sets that link."""
    sets = [np.frombuffer(x, "<u8") for x in table.column("arr").to_pylist()]
    next_band, left, right = (table.column(c)[0].as_py() for c in ("next", "left", "right"))
    found = degrees(sets, table.column("copies").to_numpy(), table.column("other").to_numpy(), next_band == 0 and left == right)
    return table.select(["n", "s1", "s2"]).append_column("links", pa.array(found)).filter(pa.array(found > 0))


def _counted(members: DataFrame) -> DataFrame:
    """(n, s1, s2, links), staged: the rows that sets (n, s1, s2, copies, arr, comp) link with through other sets."""
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int"))
    inside = Window.partitionBy("comp")  # a group's bands, some 60 at most
    at = inside.orderBy("band")
    bands = members.groupBy("comp", "band").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    bands = bands.withColumn("tiles", F.ceil(F.greatest(F.col("c") / TILE_SETS, F.col("t") / TILE_SHINGLES)).cast("int"))
    bands = bands.select(
        F.col("comp").alias("g"), F.col("band").alias("d"), "tiles", F.sum("c").over(inside).alias("all"),
        ((F.sum("c").over(inside) <= TILE_SETS) & (F.sum("t").over(inside) <= TILE_SHINGLES)).alias("whole"),
        F.when(F.lag("band").over(at) == F.col("band") - 1, F.lag("tiles").over(at)).otherwise(0).alias("below"),
        F.when(F.lead("band").over(at) == F.col("band") + 1, F.lead("tiles").over(at)).otherwise(0).alias("above"),
    ).filter("all > 1")
    dealt = members.join(bands, (F.col("comp") == F.col("g")) & (F.col("band") == F.col("d")))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("s1", "s2"), F.col("tiles")).cast("int"))

    def meets(count, make):
        return F.transform(F.array_repeat(F.lit(0), F.col(count)), lambda _, x: make(x))

    def task(band, next_band, left, right, other):
        parts = dict(band=band, next=F.lit(next_band), left=left, right=right, other=other)
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    tile, band = F.col("tile"), F.col("band")
    several = F.concat(
        meets("tiles", lambda x: task(band, 0, F.least(tile, x), F.greatest(tile, x), tile > x)),
        meets("above", lambda x: task(band, 1, tile, x, F.lit(False))),
        meets("below", lambda x: task(band - 1, 1, x, tile, F.lit(True))),
    )
    alone = F.array(task(F.lit(-1), 0, F.lit(0), F.lit(0), F.lit(False)))
    dealt = dealt.select("comp", F.explode(F.when(F.col("whole"), alone).otherwise(several)).alias("x"), "n", "s1", "s2", "copies", "arr")
    dealt = dealt.select("comp", "x.*", "n", "s1", "s2", "copies", "arr")
    found = dealt.groupBy("comp", "band", "next", "left", "right").applyInArrow(_degrees, "n long, s1 long, s2 long, links long")
    return stage(found.groupBy("n", "s1", "s2").agg(F.sum("links").alias("links")), "degrees")


def jaccard_components(docs: DataFrame, *, id_col="doc_id", text_col="text", links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; with ``links``, n_links too.

    Null and empty texts, and those without words, have no shingles and are their
    own component.  Rows with one id count as one document, as do all rows with
    a null id, whose component is null unless another document links with
    them.  n_links is the number of other rows, of whatever id, whose texts link
    with the row's.  Ids are longs above -2^63, which itself raises an overflow.
    Other columns are ignored.
    """
    source = in_blocks(docs, id_col, text_col)
    sets = _sets(source)
    # Equal sets: one of them, the least id, stands for all.
    classes = stage(sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "classes")
    first = classes.select(F.col("n").alias("f_n"), F.col("s1").alias("f1"), F.col("s2").alias("f2"), "rep", "copies")
    same = (F.col("n") == F.col("f_n")) & (F.col("s1") == F.col("f1")) & (F.col("s2") == F.col("f2"))
    some = sets.filter(F.size("tokens") > 0).join(first, same & (F.col("k") == F.col("rep")))
    band = F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int")
    keys = some.select("k", band.alias("b"), F.explode("tokens").alias("token")).select("k", "token", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("band"))
    least = keys.groupBy("token", "band").agg(F.min("k").alias("m"), F.max("k").alias("x")).filter("m <> x").select(F.col("token").alias("t"), F.col("band").alias("d"), "m")
    edges = keys.join(least, (F.col("token") == F.col("t")) & (F.col("band") == F.col("d"))).select(F.col("k").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    groups = components(edges)
    whole = sets.filter("arr is not null").select("k", "n", "arr", "s1", "s2")
    if links:  # one of each set, also where rows repeat under the least id
        whole = whole.dropDuplicates(["k", "n", "s1", "s2"])
    members = whole.join(first, same & (F.col("k") == F.col("rep"))).join(groups, F.col("k") == F.col("id"), "left" if links else "inner")
    if links:
        # Sets under one id may link with each other, though their id is in no group.
        found = members.select("n", "s1", "s2", "copies", "arr", "k", "component")
        members = stage(found, "candidates")
        counted = _counted(members.withColumn("comp", F.coalesce("component", "k")))
    verified = _verified(members.filter("component is not null").select("k", "n", "arr", F.col("component").alias("comp")))
    labels = verified.filter("k <> label").groupBy("k").agg(F.min("label").alias("label"))
    # A document repeated under one id, with other sets, ties their classes: those links join the verified ones.
    loose = sets.filter("n > 0").join(first, same).select("k", "rep").filter("k <> rep")
    ties = loose.unionByName(labels.select("k", F.col("label").alias("rep")))
    joined = components(ties.select(F.col("k").alias("u"), F.col("rep").alias("v")))
    final = joined.select(F.col("id").alias("c_id"), "component")
    out = sets.select("doc_id", "n", "k").join(final, F.col("k") == F.col("c_id"), "left")
    component = F.coalesce("component", "k")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(component != _NULL, component + 1).alias("component_id")]
    if links:
        degree = first.join(counted, (F.col("f_n") == F.col("n")) & (F.col("f1") == F.col("s1")) & (F.col("f2") == F.col("s2")), "left")
        degree = degree.select("f_n", "f1", "f2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).filter("n_links > 0")
        out = sets.select("doc_id", "n", "k", "s1", "s2").join(final, F.col("k") == F.col("c_id"), "left").join(degree, same, "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    result = stage(out.select(*columns), "jaccard")
    discard(sets, classes, groups, verified, joined, *([members, counted] if links else []))
    return result


#: DuckDB SQL: links through shared shingles, then the least id reachable.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT x, y FROM common JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)
), edge AS (
  SELECT x, y FROM linked UNION SELECT y, x FROM linked
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.x, reach.r FROM reach JOIN edge e ON e.y = reach.doc_id AND reach.r < e.x
)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, min(r) AS component_id, coalesce(degree.c, 0)::BIGINT AS n_links
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS c FROM edge GROUP BY 1) degree USING (doc_id)
JOIN reach USING (doc_id) GROUP BY 1, 2, 4
"""
