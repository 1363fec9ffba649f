"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the vector of its hash bucket joined with the mean of its
character 5-grams' vectors (bytes of the word between two spaces); buckets met in
fewer than three training texts stay at zero, so that rare words aren't learnt by heart.  Each text is scored in all windows of 32 words,
every one overlapping the next by half; the text's score comes from its highest
window.  Training picks, for each labelled text, the window that stands out now (a
text is toxic if one of its windows is), first by log-odds of words, then by the
network itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lowered, mix64, ragged, release, slices, text_bytes, trim, word_hashes

WINDOW, STRIDE = 32, 16
WORDS, GRAMS, GRAM, DIM, HIDDEN, ATTENTION = 1 << 15, 1 << 15, 5, 8, 8, 8
#: Training texts that a bucket must occur in to have a vector.
RARE = 3
#: Share of the sample that only sets the threshold.
SET_ASIDE = 0.2
#: The labelled sample's bound: texts of each class, each of at most so many characters.
TRAIN_TEXTS, TRAIN_CHARS = 1_200, 16_000
STEPS, BATCH, RATE = 260, 128, 0.01
HELD_OUT, OF = 0, 5


# ----------------------------------------------------------------- features

def words_of(texts: pa.Array):
    """Distinct words (lower case, letters, digits and whatever isn't ASCII), each token's place among them, each text's first token."""
    clean = pc.replace_substring_regex(lowered(texts), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    parts = pc.ascii_split_whitespace(clean)
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False) if len(coded.dictionary) else np.zeros(0, bool)
    index = coded.indices.to_numpy().astype(np.int64)
    good = full[index] if len(index) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(good)])
    return coded.dictionary, index[good], before[offsets]


def buckets(words: pa.Array):
    """Hash bucket of each word, and its character n-grams' buckets with each word's first one (n+1 values)."""
    joined = pa.array([f" {w} " for w in words.to_pylist()], pa.large_string())
    raw, offsets = text_bytes(joined)
    n = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = ragged(offsets[:-1], n) if len(n) else np.zeros(0, np.int64)
    r = raw.astype(np.uint64)
    code = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        code = code << np.uint64(8) | r[at + j]
    tri = mix64(code) % np.uint64(GRAMS)
    # One hash for each word: a text with one word (or, for an odd one, the sum of its parts).
    h, where = word_hashes(words, lower=False)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
    return ((total[where[1:]] - total[where[:-1]]) % np.uint64(WORDS)).astype(np.int64), tri.astype(np.int64), first


def window_index(first: np.ndarray, index: np.ndarray, blank: int):
    """(windows, WINDOW) places of words, ``blank`` where a window is not full, and each window's text."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (first[:-1][text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < first[1:][text][:, None]
    padded = np.append(index, blank)
    return padded[np.where(inside, at, len(index))], text


# ------------------------------------------------------------------ network

def new_model(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "word": np.zeros((WORDS, DIM), np.float32), "tri": np.zeros((GRAMS, DIM), np.float32),
        "wx": f(2, 2 * DIM, 3 * HIDDEN, scale=0.3), "bx": np.zeros((2, 3 * HIDDEN), np.float32),
        "uh": f(2, HIDDEN, 2 * HIDDEN, scale=0.3), "un": f(2, HIDDEN, HIDDEN, scale=0.3),
        "wa": f(2 * HIDDEN, ATTENTION, scale=0.3), "ba": np.zeros(ATTENTION, np.float32), "va": f(ATTENTION, scale=0.3),
        "wo": f(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32),
    }


def vectors(m, word, tri, first):
    """Each word's vector: its bucket's, then the mean of its n-grams'."""
    n = np.diff(first)
    rows = np.zeros((len(n), DIM), np.float32)
    some = n > 0
    if len(tri):
        rows[some] = np.add.reduceat(m["tri"][tri], first[:-1][some]) / n[some, None]
    return np.concatenate([m["word"][word], rows], 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m, xp, mask, keep=False):
    """Logits of windows.  xp: (2, M, T, 3H) projected inputs, the second direction reversed; mask: (M, T)."""
    both = np.stack([mask, mask[:, ::-1]])[..., None].astype(np.float32)
    _, rows, steps, _ = xp.shape
    h, H = np.zeros((2, rows, HIDDEN), np.float32), HIDDEN
    out, tape = np.empty((2, rows, steps, H), np.float32), []
    for t in range(steps):
        x, k = xp[:, :, t], both[:, :, t]
        g = _sigmoid(x[..., : 2 * H] + h @ m["uh"])
        z, r = g[..., :H], g[..., H:]
        rh = r * h
        n = np.tanh(x[..., 2 * H :] + rh @ m["un"])
        new = k * (n + z * (h - n)) + (1 - k) * h
        if keep:
            tape.append((h, z, r, n, rh, k))
        h = new
        out[:, :, t] = h
    seq = np.concatenate([out[0], out[1][:, ::-1]], 2)
    u = np.tanh(seq @ m["wa"] + m["ba"])
    s = np.where(mask, u @ m["va"], -1e9)
    a = np.exp(s - s.max(1, keepdims=True)) * mask
    a = a / np.maximum(a.sum(1, keepdims=True), 1e-9)
    pooled = (a[..., None] * seq).sum(1)
    logit = pooled @ m["wo"] + m["bo"][0]
    return (logit, (tape, seq, u, a, pooled)) if keep else logit


def backward(m, saved, mask, d_logit):
    """Gradients of all but the vectors, and that of xp."""
    tape, seq, u, a, pooled = saved
    H, g = HIDDEN, {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
    dp = d_logit[:, None] * m["wo"]
    da = (seq * dp[:, None]).sum(2)
    ds = a * (da - (a * da).sum(1, keepdims=True))
    du = ds[..., None] * m["va"] * (1 - u * u)
    g["va"] = (ds[..., None] * u).sum((0, 1))
    flat = du.reshape(-1, du.shape[2])
    g["wa"], g["ba"] = seq.reshape(-1, 2 * H).T @ flat, flat.sum(0)
    dseq = a[..., None] * dp[:, None] + du @ m["wa"].T
    dout = np.stack([dseq[..., :H], dseq[:, ::-1, H:]])
    dh = np.zeros_like(dout[:, :, 0])
    dxp = np.zeros((2, *mask.shape, 3 * H), np.float32)
    g["uh"], g["un"] = np.zeros_like(m["uh"]), np.zeros_like(m["un"])
    for t in reversed(range(mask.shape[1])):
        h, z, r, n, rh, k = tape[t]
        d = dh + dout[:, :, t]
        dn = d * k
        dz = dn * (h - n) * z * (1 - z)
        dpre = dn * (1 - z) * (1 - n * n)
        drh = dpre @ m["un"].transpose(0, 2, 1)
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], 2)
        g["uh"] += h.transpose(0, 2, 1) @ gates
        g["un"] += rh.transpose(0, 2, 1) @ dpre
        dxp[:, :, t, : 2 * H], dxp[:, :, t, 2 * H :] = gates, dpre
        dh = d * (1 - k) + dn * z + drh * r + gates @ m["uh"].transpose(0, 2, 1)
    return g, dxp


def window_logits(m, word, tri, first, index):
    """Logits of (windows, WINDOW) word places; the place after the last word is blank."""
    x = vectors(m, word, tri, first)
    table = np.concatenate([(x @ m["wx"] + m["bx"][:, None]).astype(np.float32), np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)
    out = np.empty(len(index), np.float32)
    for a in range(0, len(index), 2048):
        i = index[a : a + 2048]
        xp = np.stack([table[0][i], table[1][i[:, ::-1]]])
        out[a : a + 2048] = forward(m, xp, i < len(x))
    return out


def text_logits(m, texts: pa.Array) -> np.ndarray:
    """The highest window's logit of every text, less the decision's threshold."""
    words, index, first = words_of(texts)
    word, tri, tri_first = buckets(words)
    windows, text = window_index(first, index, len(words))
    logit = window_logits(m, word, tri, tri_first, windows)
    starts = np.searchsorted(text, np.arange(len(texts)))
    return np.maximum.reduceat(logit, starts) - float(m["threshold"][0]) if len(texts) else np.zeros(0)


def train(texts: list[str], toxic: np.ndarray, weight_clean: float = 1.0, seed: int = 5) -> dict[str, np.ndarray]:
    """A model from labelled texts; ``weight_clean``: clean texts that each one of the sample stands for."""
    m, rng = new_model(seed), np.random.default_rng(seed)
    m["threshold"] = np.zeros(1, np.float32)
    if not len(texts) or toxic.all() or not toxic.any():
        m["wo"][:] = 0  # nothing to learn from: every text gets the one class seen, or clean
        m["bo"][:] = 4 if len(texts) and toxic.all() else -4
        return m
    words, index, first = words_of(pa.array(texts, pa.large_string()))
    word, tri, tri_first = buckets(words)
    windows, text = window_index(first, index, len(words))
    fitted = rng.random(len(texts)) >= SET_ASIDE
    if toxic[fitted].all() or not toxic[fitted].any() or toxic[~fitted].sum() < 10:
        fitted[:] = True
    # Log-odds of a word's bucket (and of n-grams) between toxic and clean texts start the first dimension off.
    holder = np.repeat(np.arange(len(texts)), np.diff(first))

    def odds(bucket, owner, size):
        pair = np.unique((bucket * len(texts) + owner)[fitted[owner]])
        at, of = pair // len(texts), toxic[pair % len(texts)]
        bad, good = np.bincount(at[of], minlength=size), np.bincount(at[~of], minlength=size)
        lean = np.clip(np.log((bad + 1) / ((toxic & fitted).sum() + 2)) - np.log((good + 1) / ((~toxic & fitted).sum() + 2)), -4, 4)
        often = bad + good >= RARE
        return np.where(often, lean, 0).astype(np.float32), often

    lean, word_often = odds(word[index], holder, WORDS)
    m["word"][:, 0] = lean / 2
    lengths = np.diff(tri_first)[index]
    tri_lean, tri_often = odds(tri[ragged(tri_first[:-1][index], lengths)], np.repeat(holder, lengths), GRAMS)
    m["tri"][:, 0] = tri_lean
    best_of = np.zeros(len(word), np.float32)
    some = np.diff(tri_first) > 0
    best_of[some] = np.add.reduceat(tri_lean[tri], tri_first[:-1][some]) / np.diff(tri_first)[some] if len(tri) else 0
    rank = np.append(lean[word] + best_of, -9)[windows].max(1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    picks = np.zeros(0, np.int64)
    for step in range(STEPS):
        if step % (STEPS // 2) == 0:
            if step:
                rank = window_logits(m, word, tri, tri_first, windows)
            best = np.lexsort((rank, text))
            best = best[np.append(text[best][1:] != text[best][:-1], True)]  # each text's highest window
            best = best[fitted[text[best]]]
            others = np.flatnonzero(~toxic[text] & fitted[text])
            picks = np.concatenate([best, rng.choice(others, min(len(others), len(best) // 2), replace=False)])
        some = rng.choice(picks, BATCH)
        i, y = windows[some], toxic[text[some]].astype(np.float32)
        mask = i < len(words)
        near, place = np.unique(i, return_inverse=True)
        place = place.reshape(i.shape)
        real = near[near < len(words)]
        # vectors of this batch's words only
        lens = np.diff(tri_first)[real]
        t_idx, t_first = tri[ragged(tri_first[:-1][real], lens)], np.concatenate([[0], np.cumsum(lens)])
        x = np.concatenate([vectors(m, word[real], t_idx, t_first), np.zeros((len(near) - len(real), 2 * DIM), np.float32)])
        table = x @ m["wx"] + m["bx"][:, None]
        logit, saved = forward(m, np.stack([table[0][place], table[1][place[:, ::-1]]]), mask, keep=True)
        d_logit = ((_sigmoid(logit) - y) / BATCH).astype(np.float32)
        g, dxp = backward(m, saved, mask, d_logit)
        dxp *= np.stack([mask, mask[:, ::-1]])[..., None]
        dtable = np.zeros_like(table)
        np.add.at(dtable[0], place, dxp[0])
        np.add.at(dtable[1], place[:, ::-1], dxp[1])
        g["wx"], g["bx"] = x.T[None] @ dtable, dtable.sum(1)
        dx = (dtable @ m["wx"].transpose(0, 2, 1)).sum(0)[: len(real)]
        g["word"], g["tri"] = np.zeros_like(m["word"]), np.zeros_like(m["tri"])
        np.add.at(g["word"], word[real], dx[:, :DIM])
        if len(t_idx):
            np.add.at(g["tri"], t_idx, np.repeat(dx[:, DIM:] / np.maximum(lens, 1)[:, None], lens, 0))
        g["word"] *= word_often[:, None]
        g["tri"] *= tri_often[:, None]
        for k, v in g.items():
            first_m, second_m = state[k]
            first_m += 0.1 * (v - first_m)
            second_m += 0.01 * (v * v - second_m)
            m[k] -= (RATE * (first_m / (1 - 0.9 ** (step + 1))) / (np.sqrt(second_m / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    # The threshold that gives the best F1, on the texts set aside, when clean texts count as often as they occur.
    top = np.maximum.reduceat(window_logits(m, word, tri, tri_first, windows), np.searchsorted(text, np.arange(len(texts))))
    if not fitted.all():
        top, toxic = top[~fitted], toxic[~fitted]
    order = np.argsort(-top)
    hit, miss = np.cumsum(toxic[order]), np.cumsum(~toxic[order]) * weight_clean
    at = int(np.argmax(2 * hit / (hit + miss + toxic.sum())))
    m["threshold"][0] = (top[order][at] + top[order][min(at + 1, len(order) - 1)]) / 2
    return m


# -------------------------------------------------------------------- Spark

def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> dict[str, np.ndarray]:
    """Train on at most ``texts`` labelled texts of each class, those least by a digest of the id.

    Never used: rows held out (crc32 of the id as text modulo 5 is 0), rows
    without a label, a text or an id, and texts of over ``chars`` characters.
    What training took of the driver's memory is given back.
    """
    model = _fit(docs, labels, id_col, text_col, texts, chars)
    trim()
    return model


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, texts: int, chars: int) -> dict[str, np.ndarray]:
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic")).filter("l_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("l_id").cast("string").cast("binary")) % OF != HELD_OUT).distinct()
    usable = usable.join(docs.select(F.col(id_col).alias("d_id"), F.length(text_col).alias("len")), F.col("l_id") == F.col("d_id")).filter(F.col("len").between(1, chars))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows
    chosen = None
    for label in (0, 1):
        one = usable.filter(F.col("toxic") == label).select("l_id", "toxic").distinct().orderBy(F.md5(F.col("l_id").cast("string").cast("binary")), "l_id").limit(texts)
        chosen = one if chosen is None else chosen.unionByName(one)
    # At most 2 * texts rows on either side of this join and on the driver.
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("l_id") == F.col("d_id")).filter(F.length("text").between(1, chars))
    rows = rows.orderBy("d_id", "text", "toxic").limit(4 * texts).collect()
    clean = sum(r["toxic"] == 0 for r in rows)
    return train([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool), max(1.0, sizes.get(0, 0) / max(1, clean)) / max(1.0, sizes.get(1, 0) / max(1, len(rows) - clean)))


def _scorer(model, text_at: int, names: list[str]):
    def work(batches):
        release()
        for batch in batches:
            texts = batch.column(text_at)
            for a, b in slices(texts):
                logit = text_logits(model, texts.slice(a, b - a)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(batch.num_columns)] + [pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=names)
                trim()

    return work


def score(docs: DataFrame, model: dict[str, np.ndarray], *, text_col="text", score_col="score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) added, which must be a new name.

    Null and empty texts are scored as one window without words.
    """
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is a column already")
    schema = docs.limit(0).withColumn(score_col, F.lit(0.0)).schema
    return docs.mapInArrow(_scorer(model, docs.columns.index(text_col), [*docs.columns, score_col]), schema)
