"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes that cover all of it. Filters of several widths slide over a window's bytes, the
maximum of each filter over the window passes a rectifier, and a softmax over the learned languages follows; a text's scores
are the mean over its windows, weighted by their bytes. Bytes enter as classes (letters lower-cased, white space, other
ASCII, and every byte above), so a filter is one table per position. The tables are trained here with numpy.

Training reads a bounded sample: about DOCS texts in all, evenly over the languages and chosen by a hash of their id, with
PER_DOC windows each; half of the windows are cut short, so that short texts are known too. Only texts with a language are
used, and of those only ids whose crc32 modulo FOLDS is not 0.

A text that is null or has no letter is `und` with score 0; so is every text if nothing could be learned. Other columns are
ignored, repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruletide.llm import textkit as tk

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DOCS = 3200
PER_DOC = 2
EPOCHS = 6
FOLDS = 5
BATCH = 1024

#: Byte classes: 0 padding, 1 white space, 2 other ASCII, 3 to 28 letters, 29 and up the bytes of non-ASCII characters.
CLASS = np.full(256, 2, np.int32)
CLASS[tk.IS_SPACE] = 1
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(3, 29)
CLASS[0x80:] = np.arange(29, 157)
N_CLASS = 157


class ByteNet:
    """Tables t[width][position][class, filter], biases, and the softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {f"t{w}": rng.normal(0, 0.3, (w, N_CLASS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.p |= {"d": rng.normal(0, 0.3, (n, len(langs))).astype(np.float32), "e": np.zeros(len(langs), np.float32)}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross entropy; only the winning position of a filter receives a gradient."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            way = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                step += 1
                pick = way[at : at + 128]
                g = self._gradient(x[pick], y[pick])
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.999 * v2[k] + 0.001 * d * d
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, length = x.shape
        pooled, where = [], []
        for w in WIDTHS:
            t = self.p[f"t{w}"]
            conv = sum(t[j][x[:, j : length - w + 1 + j]] for j in range(w)) + self.p[f"b{w}"]
            at = conv.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        z = r @ self.p["d"] + self.p["e"]
        z = np.exp(z - z.max(1, keepdims=True))
        q = z / z.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"d": r.T @ q, "e": q.sum(0)}
        dh = (q @ self.p["d"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d, at = dh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
            gt = np.zeros_like(self.p[f"t{w}"])
            for j in range(w):
                np.add.at(gt[j], (x[np.arange(n)[:, None], at + j], np.arange(FILTERS)[None, :]), d)
            g |= {f"t{w}": gt, f"b{w}": d.sum(0)}
        return g

    def pairs(self) -> dict[tuple[int, int], np.ndarray]:
        """For each width and even position the summed table over two neighbouring classes (or one, at an odd end)."""
        out = {}
        for w in WIDTHS:
            t = self.p[f"t{w}"]
            for j in range(0, w, 2):
                out[w, j] = (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS) if j + 1 < w else t[j]
        return out

    def predict(self, x: np.ndarray, pairs: dict) -> np.ndarray:
        """Probabilities (windows, languages) of windows of byte classes."""
        n, length = x.shape
        if not n:
            return np.zeros((0, len(self.langs)), np.float32)
        xt = np.ascontiguousarray(x.T)
        two = xt[:-1] * N_CLASS + xt[1:]
        pooled = []
        for w in WIDTHS:
            best = np.full((n, FILTERS), -np.inf, np.float32)
            for i in range(length - w + 1):
                c = np.take(pairs[w, 0], two[i], axis=0)
                if w > 2:
                    c += np.take(pairs[w, 2], two[i + 2] if w == 4 else xt[i + 2], axis=0)
                np.maximum(best, c, out=best)
            pooled.append(best + self.p[f"b{w}"])
        z = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["d"] + self.p["e"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of byte classes, text number, bytes) that cover every text."""
    n = np.diff(off)
    count = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = off[doc] + inside * WINDOW
    size = np.minimum(off[doc + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    x = np.where(np.arange(WINDOW) < size[:, None], CLASS[buf[np.minimum(at, max(0, len(buf) - 1))]], 0) if len(doc) else np.zeros((0, WINDOW), np.int32)
    return x.astype(np.int32), doc, size


def held_out(id_col: Column) -> Column:
    """Whether a row is left out of training: the crc32 of its id, written as text, is divisible by FOLDS."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_most: int = DOCS) -> ByteNet | None:
    """A network trained on a bounded sample of labelled rows; None if no row has a language and a text."""
    ident = F.col(id_col)
    known = docs.where(~held_out(ident) & F.col(lang_col).isNotNull() & ident.isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = max(1, docs_most // len(counts))
    chance = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, share / n)))
    drawn = known.where(F.pmod(F.xxhash64(ident, F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(chance, F.col(lang_col)))
    raw = F.col(text_col).cast("binary")
    room = F.greatest(F.octet_length(F.col(text_col)) - WINDOW + 1, F.lit(1))
    cut = [F.substr(raw, F.pmod(F.xxhash64(ident, F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)) for k in range(PER_DOC)]
    rows = drawn.where(F.octet_length(text_col) > 0).select(F.col(lang_col).alias("lang"), ident.alias("i"), F.explode(F.array(*cut)).alias("w")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["i"], bytes(r["w"])))
    langs = sorted({r["lang"] for r in rows})
    rng = np.random.default_rng(11)
    pieces, labels = [], []
    for r in rows:
        w = bytes(r["w"])
        short = int(rng.integers(4, 64))
        at = int(rng.integers(0, max(1, len(w) - short)))
        pieces += [w, w[at : at + short]]
        labels += [langs.index(r["lang"])] * 2
    off = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    x, doc, _ = windows(np.frombuffer(b"".join(pieces), np.uint8), off)
    net = ByteNet(langs)
    net.train(x, np.array(labels)[doc])
    return net


def _has_letter(column: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = tk.per_text((CLASS[buf] >= 3) & (buf < 0x80), off) > 0
    high = tk.per_text(buf >= 0x80, off) > 0
    for i in np.flatnonzero(~out & high):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def predictor(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs() if net else {}
        for whole in batches:
            for batch in tk.slices(whole, "text", 1 << 20):
                n = len(batch)
                pred, score = np.full(n, "und", object), np.zeros(n)
                if net:
                    buf, off = tk.flat(batch.column(1))
                    x, doc, size = windows(buf, off)
                    prob = np.concatenate([net.predict(x[i : i + BATCH], pairs) for i in range(0, len(x), BATCH)]) if len(x) else np.zeros((0, len(net.langs)))
                    total = np.stack([np.bincount(doc, prob[:, k] * size, n) for k in range(len(net.langs))], 1) / np.maximum(1, np.diff(off))[:, None]
                    ok = _has_letter(batch.column(1), buf, off)
                    best = total.argmax(1)
                    pred = np.where(ok, np.array(net.langs, object)[best], "und")
                    score = np.where(ok, np.clip(total[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: ByteNet | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; trains on docs where no network is given."""
    tk.keep_batches_small(docs.sparkSession)
    net = net or train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(predictor(net), "id long, held_out boolean, lang_pred string, score double")
