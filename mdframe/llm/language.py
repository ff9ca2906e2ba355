"""Language of a text by a byte convolutional network, trained and run in numpy.

Byte embeddings, convolutions of several widths, the largest value of each filter over a window, and a softmax. A whole text is
read in windows of fixed length; their log probabilities add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import table, tune
from mdframe.llm.labelled import held_out

#: Rows that the network learns from, at most, and windows of each.
FIT_ROWS = 4000
FIT_WINDOWS = 3
FOLDS, FOLD = 3, 1
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
WINDOWS_AT_ONCE = 512
_letter = regex.compile(r"\p{L}").search


def windows_of(raw: bytes) -> np.ndarray:
    """All of a text's bytes as rows of ``WINDOW``; the last row ends with the text, and a short text is padded with spaces."""
    if len(raw) <= WINDOW:
        raw = raw.ljust(WINDOW, b" ")
    flat = np.frombuffer(raw, np.uint8)
    full = len(flat) // WINDOW
    rows = flat[: full * WINDOW].reshape(full, WINDOW)
    return np.vstack([rows, flat[-WINDOW:][None]]) if len(flat) % WINDOW else rows


class ByteNetwork:
    """The network: ``fit`` by Adam on labelled windows, ``log_probabilities`` of windows."""

    def __init__(self, classes: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype("f4")}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype("f4")
            self.p[f"b{w}"] = np.zeros(FILTERS, "f4")
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype("f4")
        self.p["c"] = np.zeros(len(classes), "f4")
        self.tables = None

    def __getstate__(self):
        return {"classes": self.classes, "p": self.p, "tables": None}

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        n, e = len(x), self.p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            patches = np.concatenate([e[:, i : WINDOW - w + 1 + i] for i in range(w)], axis=2)
            z = patches @ self.p[f"k{w}"] + self.p[f"b{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            kept.append((at, top > 0))
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, axis=1)
        logits = h @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=1, keepdims=True)
        loss = -np.log(q[np.arange(n), y] + 1e-9).mean()
        d = q
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = d @ self.p["o"].T
        for i, w in enumerate(WIDTHS):
            at, on = kept[i]
            dz = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            g[f"b{w}"] = dz.sum(axis=0)
            spans = at[:, :, None] + np.arange(w)  # n, filters, w
            codes = x[np.arange(n)[:, None, None], spans]
            picked = self.p["e"][codes].reshape(n, FILTERS, w * EMBEDDING)
            g[f"k{w}"] = np.einsum("nf,nfk->kf", dz, picked)
            back = (dz[:, :, None] * self.p[f"k{w}"].T[None]).reshape(-1, EMBEDDING)
            np.add.at(g["e"], codes.ravel(), back)
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                some = order[s : s + batch]
                _, g = self._step(x[some], y[some])
                t += 1
                lr = rate * (1 - epoch / (epochs + 1))
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.01 * (g[k] ** 2 - v2[k])
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-7)).astype("f4")
        self.tables = None

    def _tables(self) -> dict:
        """For each width, what single bytes or pairs of bytes add to the filters."""
        e, out = self.p["e"], {}
        for w in WIDTHS:
            k = self.p[f"k{w}"].reshape(w, EMBEDDING, FILTERS)
            parts = []
            for i in range(0, w - 1, 2):
                parts.append((i, True, ((e @ k[i])[None] + (e @ k[i + 1])[:, None]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, False, e @ k[w - 1]))
            out[w] = parts
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = self._tables()
        out = []
        for s in range(0, len(x), WINDOWS_AT_ONCE):
            some = x[s : s + WINDOWS_AT_ONCE]
            pairs = some[:, :-1].astype(np.uint16) | (some[:, 1:].astype(np.uint16) << 8)
            pooled = []
            for w in WIDTHS:
                z, size = None, WINDOW - w + 1
                for i, two, t in self.tables[w]:
                    part = t[pairs[:, i : i + size]] if two else t[some[:, i : i + size]]
                    if z is None:
                        z = part
                    else:
                        z += part
                pooled.append(np.maximum(z.max(axis=1) + self.p[f"b{w}"], 0))
            logits = np.concatenate(pooled, axis=1) @ self.p["o"] + self.p["c"]
            logits = logits - logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), "f4")


def fit_languages(docs: DataFrame, most: int = FIT_ROWS) -> ByteNetwork | None:
    """Train on at most ``most`` rows outside the held-out fold with a language and a letter; None if there are none.

    Rows are chosen by a hash of id, language and text, so equal rows count once. Windows are cut where the texts are: ``FIT_WINDOWS`` of
    each row, chosen by the hash, reach the driver, whatever the texts' length.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id", FOLDS, FOLD))
    rows = rows.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "lang", "text").alias("k"), "lang", "text")
    chosen = rows.select("h", "k").distinct().orderBy("h", "k").limit(most)

    def cut(it):
        for batch in it:
            out = []
            for k, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                w = windows_of(text.encode("utf-8", "replace"))
                some = np.random.default_rng(k & (1 << 63) - 1).choice(len(w), min(FIT_WINDOWS, len(w)), replace=False)
                out += [(k, lang, n, w[i].tobytes()) for n, i in enumerate(some)]
            yield pa.RecordBatch.from_pylist([dict(zip(("k", "lang", "n", "w"), r, strict=True)) for r in out], pa.schema([("k", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("w", pa.binary())]))

    met = rows.join(F.broadcast(chosen), ["h", "k"]).select("k", "lang", "text")
    picked = sorted(met.mapInArrow(cut, "k long, lang string, n int, w binary").distinct().collect())
    if not picked:
        return None
    classes = sorted({r[1] for r in picked})
    net = ByteNetwork(classes)
    net.fit(np.frombuffer(b"".join(r[3] for r in picked), np.uint8).reshape(-1, WINDOW), np.array([classes.index(r[1]) for r in picked]))
    return net


def predict_texts(texts: list[str | None], net: ByteNetwork | None) -> tuple[list[str], list[float]]:
    """Language and score of each text; windows of many texts go through the network together, a bounded number at a time."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return lang, score
    totals, counts = np.zeros((len(texts), len(net.classes))), np.zeros(len(texts), int)
    held: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def run():
        out = net.log_probabilities(np.concatenate([w for _, w in held]))
        np.add.at(totals, np.repeat([k for k, _ in held], [len(w) for _, w in held]), out)

    for k, text in enumerate(texts):
        if not text or not _letter(text):
            continue
        windows = windows_of(text.encode("utf-8", "replace"))
        counts[k] = len(windows)
        for s in range(0, len(windows), 4 * WINDOWS_AT_ONCE):
            held.append((k, windows[s : s + 4 * WINDOWS_AT_ONCE]))
            waiting += len(held[-1][1])
            if waiting >= 4 * WINDOWS_AT_ONCE:
                run()
                held.clear()
                waiting = 0
    if held:
        run()
    for k in np.flatnonzero(counts):
        mean = totals[k] / counts[k]
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        lang[k], score[k] = net.classes[best], float(p[best] / p.sum())
    return lang, score


def predict_language(docs: DataFrame, net: ByteNetwork | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row from its whole text; ``und`` and 0 where the text is null, has no letter, or nothing was learned.

    All windows of a text count alike, however many; repeated rows each have their own row, and of languages that tie the first by name wins.
    """
    def run(it):
        for batch in it:
            lang, score = predict_texts(batch.column(1).to_pylist(), net)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; a row for each row, whatever its id or text (see :func:`predict_language`)."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    net = fit_languages(docs)
    return predict_language(docs, net).select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
