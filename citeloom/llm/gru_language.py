"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads windows of SPAN bytes in both directions and gives every position a distribution over
the languages; a text's distribution is the mean over its positions that hold a letter. It's trained in numpy
by back-propagation through time, on windows that are cut inside Spark tasks from at most SAMPLE labelled
texts of each language, chosen by a hash; every text is then labelled whole, window after window.

Texts that are null or have no letter (Unicode category L) get UNKNOWN with score 0. If there is no labelled text
to learn from, all do. Every label of the training rows is learned; on ties the first label in order is taken.
Rows are judged alone: repeated rows, rows without a doc_id and very long texts are no special case, and columns
other than doc_id, text and lang are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import bound_batches

UNKNOWN = "und"
#: Texts of a language and windows of a text that are learned from at most.
SAMPLE, PER_TEXT, CHANCES = 400, 4, 1_000_003
#: HIDDEN units in a direction, more for many languages.
SPAN, HIDDEN, BATCH, STEPS, RATE = 64, 8, 256, 500, 0.02
_LETTER = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
#: Bytes of the character that a byte begins, 0 for one inside a character, and what of it belongs to the code point.
_BYTES = np.repeat(np.array([1, 0, 2, 3, 4], np.int8), [0x80, 0x40, 0x20, 0x10, 0x10])
_OWN = np.array([0, 0x7F, 0x1F, 0x0F, 0x07])


def letters_of(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 data are of letters."""
    size = _BYTES[data]
    out = np.zeros(len(data) + 4, bool)
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    for n in (1, 2, 3, 4):
        at = np.flatnonzero(size == n)
        if len(at):
            points = padded[at] & _OWN[n]
            for k in range(1, n):
                points = points << 6 | padded[at + k] & 0x3F
            at = at[_LETTER[np.minimum(points, sys.maxunicode)]]
            for k in range(n):
                out[at + k] = True
    return out[: len(data)]


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax at every position.

    Gates are tanh with the affine step to a sigmoid folded in: z = (tanh + 1) / 2.
    """

    def __init__(self, languages: list[str], seed: int = 1):
        rng, n = np.random.default_rng(seed), len(languages)
        h = self.hidden = max(HIDDEN, 2 * ceil(log2(n + 1)))
        draw = lambda *s: (rng.standard_normal(s) * (0.5 / np.sqrt(s[0] if s[0] != 256 else 4))).astype(np.float32)
        self.languages = languages
        self.w: dict[str, np.ndarray] = {"out": draw(2 * h, n), "bias": np.zeros(n, np.float32)}
        for d in "fb":
            self.w |= {f"zr{d}": draw(256, 2 * h), f"n{d}": draw(256, h), f"uzr{d}": draw(h, 2 * h), f"un{d}": draw(h, h)}

    def _run(self, data: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (SPAN, windows, hidden) of one direction; data is (SPAN, windows)."""
        w, h = self.w, self.hidden
        wzr, wn, uzr, un = w[f"zr{d}"], w[f"n{d}"], w[f"uzr{d}"], w[f"un{d}"]
        steps, b = data.shape
        states, kept = np.empty((steps, b, h), np.float32), []
        last, gzr, gn = np.zeros((b, h), np.float32), np.empty((b, 2 * h), np.float32), np.empty((b, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(wzr, data[t], 0, gzr, "clip")
            np.take(wn, data[t], 0, gn, "clip")
            gzr += last @ uzr
            np.tanh(gzr, gzr)
            r = gzr[:, h:] + 1.0
            a = last @ un
            new = np.tanh(gn + r * a)
            z = (gzr[:, :h] + 1.0) * 0.5
            if keep:
                kept.append((t, last, gzr.copy(), r, a, new, z))
            last = states[t]
            np.subtract(kept[-1][1] if keep else (states[t - 1] if d == "f" and t else states[t + 1] if d == "b" and t < steps - 1 else 0.0), new, out=last)
            last *= z
            last += new
        return states, kept

    def probabilities(self, data: np.ndarray, keep: bool = False) -> tuple:
        forward, kf = self._run(data, "f", keep)
        backward, kb = self._run(data, "b", keep)
        h = self.hidden
        logits = forward @ self.w["out"][:h]
        logits += backward @ self.w["out"][h:]
        logits += self.w["bias"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, logits)
        logits /= logits.sum(-1, keepdims=True)
        return (logits, forward, backward, kf, kb) if keep else (logits,)

    def gradients(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the weighted positions and its gradients. target: (windows,), weight: (SPAN, windows)."""
        p, forward, backward, kf, kb = self.probabilities(data, keep=True)
        h, total = self.hidden, max(weight.sum(), 1.0)
        right = p[:, np.arange(len(target)), target]
        loss = float(-(np.log(right + 1e-9) * weight).sum() / total)
        delta = p
        delta[:, np.arange(len(target)), target] -= 1.0
        delta *= (weight / total)[..., None]
        flat = delta.reshape(-1, delta.shape[-1])
        g = {"out": np.concatenate([s.reshape(-1, h).T @ flat for s in (forward, backward)]), "bias": flat.sum(0)}
        for d, kept, part in (("f", kf, slice(0, h)), ("b", kb, slice(h, 2 * h))):
            back, uzr, un = delta @ self.w["out"][part].T, self.w[f"uzr{d}"], self.w[f"un{d}"]
            for k in (f"zr{d}", f"n{d}", f"uzr{d}", f"un{d}"):
                g[k] = np.zeros_like(self.w[k])
            carry = np.zeros_like(back[0])
            for t, last, gzr, r, a, new, z in reversed(kept):
                dh = back[t] + carry
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (last - new) * 0.5
                dr = dn * a
                dzr = np.concatenate([dz, dr], 1) * (1 - gzr * gzr)
                da = dn * r
                np.add.at(g[f"zr{d}"], data[t], dzr)
                np.add.at(g[f"n{d}"], data[t], dn)
                g[f"uzr{d}"] += last.T @ dzr
                g[f"un{d}"] += last.T @ da
                carry = dh * z + dzr @ uzr.T + da @ un.T
        return loss, g

    def train(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        """windows (n, SPAN) bytes, target (n,): Adam on batches that hold all languages alike."""
        letters = letters_of(windows.reshape(-1)).reshape(windows.shape)
        rng, groups = np.random.default_rng(seed), [np.flatnonzero(target == k) for k in range(len(self.languages))]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(x, max(1, BATCH // len(groups))) for x in groups])
            data = np.ascontiguousarray(windows[at].T)
            _, g = self.gradients(data, target[at], np.ascontiguousarray(letters[at].T).astype(np.float32))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, d in g.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def pooled(self, texts: pa.Array, group: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Mean distribution of each text over its letters, and how many positions held one."""
        data, at = A.text_bytes(texts)
        n, size = len(texts), np.diff(at)
        many = -(-size // SPAN)
        text = np.repeat(np.arange(n), many)
        start = at[:-1][text] + SPAN * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        length = np.minimum(at[1:][text] - start, SPAN)
        padded, of_letters = (np.append(x, np.zeros(SPAN, x.dtype)) for x in (data, letters_of(data)))
        sums, letters = np.zeros((n, len(self.languages))), np.zeros(n)
        within = np.arange(SPAN)[:, None]
        for low in range(0, len(start), group):
            s, of = start[low : low + group], text[low : low + group]
            there = within < length[low : low + group]
            window = np.where(there, padded[within + s], 0x20)
            p = self.probabilities(window)[0]
            weight = (of_letters[within + s] & there).astype(np.float32)
            by_window = np.einsum("tbk,tb->bk", p, weight)
            for k in range(by_window.shape[1]):
                sums[:, k] += np.bincount(of, by_window[:, k], n)
            letters += np.bincount(of, weight.sum(0), n)
        return sums / np.maximum(letters, 1)[:, None], letters


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PER_TEXT windows of each text, at equal distances."""
    for batch in A.slices(batches, "text"):
        data, at = A.text_bytes(batch.column("text"))
        rows = []
        for lang, low, high in zip(batch.column("lang").to_pylist(), at[:-1], at[1:]):
            for start in sorted({int(low + (high - low - SPAN) * k // max(1, PER_TEXT - 1)) if high - low > SPAN else int(low) for k in range(PER_TEXT)}):
                rows.append((lang, data[start : min(start + SPAN, high)].tobytes().ljust(SPAN, b" ")))
        yield pa.record_batch({"lang": pa.array([r[0] for r in rows], pa.string()), "window": pa.array([r[1] for r in rows], pa.binary())})


def learn(labelled: DataFrame) -> Network | None:
    """A network trained on labelled (doc_id, text, lang); None if it has no usable row."""
    rows = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and trim(text) <> ''")
    # The hash is of the whole row, so rows that share a doc_id are chosen one by one.
    rows = rows.withColumn("chance", F.pmod(F.xxhash64("doc_id", "text"), F.lit(CHANCES)))
    counts = rows.groupBy("lang").agg(F.count("*"), F.min("chance")).collect()  # a row a language
    if not counts:
        return None
    # By a hash threshold, about SAMPLE texts of each language, and the least hash in any case: no sort of a large group.
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for lang, x in zip([c[0] for c in counts], values) for x in (lang, x))), F.col("lang"))
    most = of([max(int(min(1.0, SAMPLE / n) * CHANCES), least + 1) for _, n, least in counts])
    chosen = rows.where(F.col("chance") < most)
    windows = chosen.select("text", "lang").mapInArrow(_windows, "lang string, window binary")
    # Copies can pass together: each language keeps so many windows at most.
    rank = F.expr("row_number() over (partition by lang order by xxhash64(window), window)")
    windows = windows.withColumn("rank", rank).where(F.col("rank") <= 2 * SAMPLE * PER_TEXT).select("lang", "window").toPandas()
    windows = windows.sort_values(["lang", "window"], ignore_index=True)
    languages = sorted(set(windows["lang"]))
    if not languages:
        return None
    network = Network(languages)
    data = np.frombuffer(b"".join(windows["window"]), np.uint8).reshape(-1, SPAN)
    network.train(data, windows["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy())
    return network


def _labelled(batches: Iterator[pa.RecordBatch], network: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text"):
        n = batch.num_rows
        if network is None:
            names, score = [UNKNOWN] * n, np.zeros(n)
        else:
            p, letters = network.pooled(batch.column("text"))
            best = p.argmax(1)
            names = [network.languages[k] if x else UNKNOWN for k, x in zip(best, letters)]
            score = np.where(letters > 0, p[np.arange(n), best].clip(0, 1), 0.0)
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def label(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, lang_pred, score, one row a row of docs."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _labelled(it, network), "doc_id long, held_out boolean, lang_pred string, score double")


def _fitting(batches: Iterator[pa.RecordBatch], network: Network | None, least: float) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text"):
        if network is not None:
            p, letters = network.pooled(batch.column("text"))
            batch = batch.filter(pa.array((letters > 0) & (p.max(1) >= least)))
        yield batch


def keep_known(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """The rows of docs, with all columns, whose text gets a language with a score of least or more. Without a
    network no row can be judged, and all stay."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _fitting(it, network, least), docs.schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """As label(), by a network learned from the rows of docs (with lang) that are not held out."""
    return label(docs, learn(docs.where(~held_out(F.col("doc_id")))))
