"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as one line of bytes, lower case in ASCII, with one space for every run of white
space. Two gated recurrent networks run over it from left and right, across words; both states at a
position give the probabilities of its language, and a document's probabilities are the mean over
all its positions. For long texts the line is cut into windows of STEP positions, and either network
starts CONTEXT positions before its window, so that its state has settled when the window begins;
every position is labelled once. Windows of many texts go through the networks side by side, so
memory is bounded by WINDOWS whatever the length of a text.

The networks are trained here, in numpy, by backpropagation through time, on pieces of PIECE bytes
from a bounded sample of labelled rows: some TRAIN_DOCS rows of each language, at most TRAIN_ROWS in
all (so at most that many languages), of at most TRAIN_BYTES bytes, and TRAIN_PIECES pieces of them.
Prediction reads every whole text.

Defined results: und for a null text or one without a letter, with score 0. Without any training
row every text is und. Rows of equal texts get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_or_empty

TRAIN_DOCS = 400
TRAIN_ROWS = 4_000
TRAIN_BYTES = 16_384
TRAIN_PIECES = 10_000
PIECE = 64
EMBED = 12
HIDDEN = 12
EPOCHS, MOST_EPOCHS = 3, 45
BATCH = 64
RATE = 0.01
STEP, CONTEXT = 384, 16
WINDOWS = 512
SEED = 11
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = 32


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights and both passes. Gates are laid out as update, reset, candidate."""

    def __init__(self, classes: list[str], weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        self.classes = classes
        if weights is None:
            r, h, e = np.random.default_rng(seed), HIDDEN, EMBED
            weights = {"emb": r.normal(0, 0.3, (256, e)), "out": r.normal(0, 0.1, (2 * h, len(classes))), "bias": np.zeros(len(classes))}
            for d in "fb":
                weights |= {f"w{d}": r.normal(0, e**-0.5, (e, 3 * h)), f"u{d}": r.normal(0, h**-0.5, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w = weights

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: bytes (steps, lines). States after each step; what the way back needs, if keep."""
        h = HIDDEN
        of_byte = self.w["emb"] @ self.w[f"w{d}"] + self.w[f"c{d}"]
        u = self.w[f"u{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        states, held = np.empty((*x.shape, h), np.float32), []
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            gates_in = of_byte[x[t]]
            zr = _sigmoid(gates_in[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gates_in[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            m = mask[t][:, None]
            new = state + m * (1 - z) * (n - state)
            if keep:
                held.append((t, state, z, r, n, m))
            state = states[t] = new
        return states, held

    def _states(self, x: np.ndarray, d: str, there: slice) -> np.ndarray:
        """States at the places there, (steps, units, lines): _run without the way back, in place and unit by unit."""
        h, w = HIDDEN, self.w
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        of_byte = np.ascontiguousarray(((w["emb"] @ w[f"w{d}"] + w[f"c{d}"]) * half).T.astype(np.float32))
        u = np.ascontiguousarray((w[f"u{d}"] * half).T.astype(np.float32))
        lines = x.shape[1]
        state, gates, some = np.zeros((h, lines), np.float32), np.empty((3 * h, lines), np.float32), np.empty((2 * h, lines), np.float32)
        out = np.empty((there.stop - there.start, h, lines), np.float32)
        zr, n = gates[: 2 * h], gates[2 * h :]
        places = range(there.stop) if d == "f" else range(len(x) - 1, there.start - 1, -1)
        for t in places:
            np.take(of_byte, x[t], axis=1, out=gates, mode="clip")
            np.matmul(u[: 2 * h], state, out=some)
            zr += some
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            np.multiply(zr[h:], state, out=some[:h])
            np.matmul(u[2 * h :], some[:h], out=some[h:])
            n += some[h:]
            np.tanh(n, out=n)
            state -= n
            state *= zr[:h]
            state += n
            if there.start <= t < there.stop:
                out[t - there.start] = state
        return out

    def labels(self, x: np.ndarray, there: slice) -> np.ndarray:
        """Probabilities at the places there of every line: (steps, classes, lines)"""
        f, b = (self._states(x, d, there) for d in "fb")
        out, h = self.w["out"].T.astype(np.float32), HIDDEN
        e = np.ascontiguousarray(out[:, :h]) @ f + np.ascontiguousarray(out[:, h:]) @ b
        e += self.w["bias"].astype(np.float32)[:, None]
        e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(1, keepdims=True)
        return e

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its derivatives."""
        h, w = HIDDEN, self.w
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        logits = both @ w["out"] + w["bias"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        n_all = mask.sum()
        true = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0]
        loss = -(np.log(true + 1e-9) * mask).sum() / n_all
        dlog = p.copy()
        dlog[:, np.arange(len(y)), y] -= 1
        dlog *= mask[:, :, None] / n_all
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = both.reshape(-1, 2 * h).T @ dlog.reshape(-1, dlog.shape[2])
        g["bias"] = dlog.sum((0, 1))
        dboth = dlog @ w["out"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, carry = w[f"u{d}"], np.zeros((x.shape[1], h), np.float32)
            dgates = np.zeros((*x.shape, 3 * h), np.float32)
            for t, before, z, r, n, m in reversed(runs[d][1]):
                dh = dboth[t, :, part] + carry
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = -dh * m * (n - before) * z * (1 - z)
                drs = dn @ u[:, 2 * h :].T
                dr = drs * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                carry = dh * (1 - m * (1 - z)) + drs * r + dzr @ u[:, : 2 * h].T
                g[f"u{d}"][:, : 2 * h] += before.T @ dzr
                g[f"u{d}"][:, 2 * h :] += (r * before).T @ dn
                dgates[t] = np.concatenate([dzr, dn], 1)
            flat = dgates.reshape(-1, 3 * h)
            g[f"c{d}"] = flat.sum(0)
            g[f"w{d}"] = w["emb"][x].reshape(-1, w["emb"].shape[1]).T @ flat
            np.add.at(g["emb"], x.reshape(-1), flat @ w[f"w{d}"].T)
        return float(loss), g


def _layout(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (steps, pieces) and which of them are there."""
    size = max(map(len, pieces))
    x = np.full((size, len(pieces)), _SPACE, np.uint8)
    mask = np.zeros((size, len(pieces)), np.float32)
    for k, piece in enumerate(pieces):
        x[: len(piece), k] = np.frombuffer(piece, np.uint8)
        mask[: len(piece), k] = 1
    return x, mask


def train(pieces: list[bytes], labels: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on batches of pieces of like length."""
    net, r = Network(classes, seed=seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    by_length = np.argsort([len(x) for x in pieces], kind="stable")
    batches = [by_length[i : i + BATCH] for i in range(0, len(pieces), BATCH)]
    step, steps = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in r.permutation(len(batches)):
            x, mask = _layout([pieces[i] for i in batches[b]])
            _, g = net.gradient(x, mask, labels[batches[b]])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, v in net.w.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                v -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def line_of(text: str) -> bytes:
    """The bytes that are read: lower case in ASCII, a space for each run of white space, and one at either end."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return b" " + b" ".join(words) + b" "


def sums_of(net: Network, lines: list[bytes]) -> np.ndarray:
    """(lines, classes): the sums of the probabilities at all places of each line."""
    pad = b" " * CONTEXT
    buffer = np.frombuffer(b"".join(pad + x + pad for x in lines) + b" " * STEP, np.uint8)
    lengths = np.array([len(x) for x in lines], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 2 * CONTEXT)[:-1]])
    n = -(-lengths // STEP)
    line = np.repeat(np.arange(len(lines)), n)
    no = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = lengths[line] - no * STEP  # places from the window's begin to the line's end
    out = np.zeros((len(lines), len(net.classes)))
    by_size = np.argsort(left, kind="stable")  # short windows side by side, so that little is read in vain
    for at in range(0, len(by_size), WINDOWS):
        some = by_size[at : at + WINDOWS]
        size = int(min(STEP, left[some].max()))
        x = buffer[(begin[line[some]] + no[some] * STEP)[None, :] + np.arange(size + 2 * CONTEXT)[:, None]]
        p = net.labels(x, slice(CONTEXT, CONTEXT + size))
        there = np.arange(size)[:, None] < left[some][None, :]
        np.add.at(out, line[some], (p * there[:, None, :]).sum(0).T)
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def _sample(docs: DataFrame, per_class: int) -> list:
    """At most per_class rows of each language, by a hash of doc_id; text and lang alone."""
    rows = docs.where("lang is not null").where(~held_out()).where(F.octet_length(text_or_empty()) <= TRAIN_BYTES)
    # each language needs a row of the sample, so no more than TRAIN_ROWS of them can be learned
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TRAIN_ROWS).collect()
    if not sizes:
        return []
    per_class = min(per_class, max(1, TRAIN_ROWS // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, per_class / r["count"]) * (1 << 30)) + 1) for r in sizes], "_lang string, _share long")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30))
    drawn = rows.join(F.broadcast(shares), F.expr("lang = _lang")).where(draw < F.col("_share"))  # at most TRAIN_ROWS rows
    return drawn.orderBy(draw, "doc_id").limit(TRAIN_ROWS).select("text", "lang").collect()


def fit(docs: DataFrame, per_class: int = TRAIN_DOCS, seed: int = SEED) -> Network | None:
    rows = _sample(docs, per_class)
    classes = sorted({r.lang for r in rows})
    if not classes:
        return None
    r = np.random.default_rng(seed)
    pieces, labels = [], []
    each = max(1, TRAIN_PIECES // len(classes))
    for k, c in enumerate(classes):
        lines = sorted(line_of(x.text or "") for x in rows if x.lang == c)
        own = [x[i : i + PIECE] for x in lines for i in range(0, len(x), PIECE) if len(x) > 2]
        chosen = r.choice(len(own), min(each, len(own)), replace=False) if own else []
        pieces += [own[i] for i in chosen]
        labels += [k] * len(chosen)
    # a small sample is read more often, so that the networks take as many steps as on a large one
    epochs = min(MOST_EPOCHS, EPOCHS * max(1, TRAIN_PIECES // max(1, len(pieces))))
    return train(pieces, np.array(labels), classes, epochs, seed) if pieces else None


#: Bytes of text that go through the networks together, some windows more than WINDOWS.
TOGETHER = 1 << 19


def with_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score."""
    if net is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast((net.classes, net.w))  # some 30 KB

    @F.arrow_udf("struct<lang: string, score: double>")
    def read(texts: pa.Array) -> pa.Array:
        net = Network(*sent.value)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, bytes]] = []

        def read_held() -> None:
            sums = sums_of(net, [x for _, x in held])
            for (i, x), total in zip(held, sums, strict=True):
                k = int(total.argmax())
                langs[i], scores[i] = net.classes[k], min(1.0, float(total[k] / len(x)))
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            text = t.as_py()
            if any(map(str.isalpha, text)):
                held.append((i, line_of(text)))
                size += len(text)
            if size >= TOGETHER:
                read_held()
                size = 0
        if held:
            read_held()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    out = docs.withColumn("_read", read(text_or_empty()))
    return out.withColumn("lang_pred", F.col("_read.lang")).withColumn("score", F.col("_read.score")).drop("_read")


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score."""
    net = fit(docs)
    return with_language(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
