"""Language ID: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one reading each way, label every byte; a document's probabilities are the mean over its bytes. The
network is trained here in numpy by backpropagation through time, on windows of a bounded sample of labelled rows that are not held
out. Texts are read whole, in stretches of ``Shape.stretch`` bytes that each start from a zero state.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every document is ``und``; a
null doc_id is never learned from and not held out; repeated rows get the same result each; an empty table gives an empty result;
columns other than doc_id, text and lang are not read, and lang only to learn.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.hashing import Texts, release, tidy

UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    """Size of the network and bounds of its training.

    The training sample holds whole texts of at most ``rows`` different labelled rows and, but for the last text of each language,
    ``sample_bytes`` in all; each language has an equal part of both. Each of ``steps`` steps learns from ``batch`` windows of
    ``window`` bytes, drawn from everywhere in these texts.
    """

    hidden: int = 12
    stretch: int = 192
    rows: int = 3000
    sample_bytes: int = 48 << 20
    window: int = 96
    batch: int = 192
    steps: int = 260
    rate: float = 0.012
    seed: int = 11


class Layer:
    """One direction. x: table of a byte's part of the update gate, reset gate and candidate; u: the former state's; c: the candidate's bias inside the reset."""

    NAMES = ("xz", "xr", "xn", "uz", "ur", "un", "c")

    def __init__(self, weights: dict[str, np.ndarray], prefix: str):
        self.w = [weights[prefix + n] for n in self.NAMES]

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, update gate, reset gate, candidate, what the reset scales)."""
        xz, xr, xn, uz, ur, un, c = self.w
        z = h @ uz
        z += xz.take(byte, 0)
        np.tanh(z, out=z)
        z *= 0.5
        z += 0.5
        r = h @ ur
        r += xr.take(byte, 0)
        np.tanh(r, out=r)
        r *= 0.5
        r += 0.5
        inner = h @ un
        inner += c
        n = r * inner
        n += xn.take(byte, 0)
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, inner

    def back(self, grad: list[np.ndarray], dh: np.ndarray, byte: np.ndarray, h: np.ndarray, z: np.ndarray, r: np.ndarray, n: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Adds to the weights' gradients; gives the former state's. Gates are tanh of the sum, halved and shifted."""
        _, _, _, uz, ur, un, _ = self.w
        dz = dh * (h - n) * (2 * z * (1 - z))
        dn = dh * (1 - z) * (1 - n * n)
        dr = dn * inner * (2 * r * (1 - r))
        di = dn * r
        for k, d in enumerate((dz, dr, dn)):
            np.add.at(grad[k], byte, d)
        for k, d in ((3, dz), (4, dr), (5, di)):
            grad[k] += h.T @ d
        grad[6] += di.sum(0)
        return dh * z + dz @ uz.T + dr @ ur.T + di @ un.T


def start(shape: Shape, classes: int) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(shape.seed), shape.hidden
    w = {}
    for d in "fb":
        for n in ("xz", "xr", "xn"):
            w[d + n] = rng.normal(0, 0.3, (256, h))
        for n in ("uz", "ur", "un"):
            w[d + n] = rng.normal(0, 0.5 / np.sqrt(h), (h, h))
        w[d + "c"] = np.zeros(h)
        w[d + "o"] = rng.normal(0, 0.3, (h, classes))
    w["o"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in w.items()}


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def loss_and_gradient(w: dict[str, np.ndarray], data: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of every position, and its gradient by backpropagation through time. data: (positions, windows)."""
    steps, width = data.shape
    layers = {d: Layer(w, d) for d in "fb"}
    order = {"f": range(steps), "b": range(steps - 1, -1, -1)}
    trace, state = {}, {}
    for d, layer in layers.items():
        h, kept, states = np.zeros((width, w["fc"].shape[0]), w["o"].dtype), [None] * steps, [None] * steps
        for t in order[d]:
            new, *rest = layer.step(data[t], h)
            kept[t], h = (h, *rest), new
            states[t] = new
        trace[d], state[d] = kept, np.stack(states)
    p = softmax(state["f"] @ w["fo"] + state["b"] @ w["bo"] + w["o"])
    rows = np.arange(width)
    loss = float(-(np.log(p[:, rows, label] + 1e-9) * weight).sum() / (steps * weight.sum()))
    p[:, rows, label] -= 1
    d_out = p * (weight / (steps * weight.sum()))[None, :, None]
    grad = {"o": d_out.sum((0, 1))}
    for d, layer in layers.items():
        grad[d + "o"] = np.einsum("twh,twc->hc", state[d], d_out)
        own = [np.zeros_like(x) for x in layer.w]
        d_state, dh = d_out @ w[d + "o"].T, 0
        for t in reversed(order[d]):
            dh = layer.back(own, dh + d_state[t], data[t], *trace[d][t])
        grad |= {d + n: g for n, g in zip(Layer.NAMES, own, strict=True)}
    return loss, grad


def train(texts: list[bytes], label: np.ndarray, classes: int, shape: Shape) -> dict[str, np.ndarray]:
    """Adam over windows of the texts, every class drawn as often, every byte of a class's texts too; a shorter text is repeated up to the window's length."""
    texts = [x * (shape.window // len(x) + 1) if len(x) < shape.window else x for x in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(x) for x in texts])
    begin = np.cumsum(size) - size
    starts = size - shape.window + 1
    own = [np.flatnonzero(label == c) for c in range(classes)]
    reach = [np.cumsum(starts[i]) for i in own]
    w, rng = start(shape, classes), np.random.default_rng(shape.seed + 1)
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for i in range(1, shape.steps + 1):
        drawn = rng.integers(0, classes, shape.batch)
        at = np.empty(shape.batch, np.int64)
        for c in range(classes):
            here = np.flatnonzero(drawn == c)
            place = rng.integers(0, reach[c][-1], len(here))
            text = np.searchsorted(reach[c], place, "right")
            at[here] = begin[own[c][text]] + place - (reach[c][text] - starts[own[c][text]])
        _, grad = loss_and_gradient(w, data[at + np.arange(shape.window)[:, None]], drawn, np.ones(shape.batch, np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = shape.rate * min(1.0, 2 * (1 - i / (shape.steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return w


def position_sums(w: dict[str, np.ndarray], data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each stretch (a column of data) the sum of its positions' probabilities. data is zero beyond a stretch's length."""
    steps, width = data.shape
    f, b = Layer(w, "f"), Layer(w, "b")
    h = np.zeros((width, w["fc"].shape[0]), np.float32)
    out = np.empty((steps, width, len(w["o"])), np.float32)
    for t in range(steps):
        h = f.step(data[t], h)[0]
        np.matmul(h, w["fo"], out=out[t])
    h = np.zeros_like(h)
    sums = np.zeros((width, len(w["o"])))
    for t in range(steps - 1, -1, -1):
        h = b.step(data[t], h)[0]
        inside = t < length
        h *= inside[:, None]  # the backward state is zero until the stretch's last byte
        p = out[t]
        p += h @ w["bo"]
        p += w["o"]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p *= (inside / p.sum(1))[:, None]
        sums += p
    return sums


def probabilities(w: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, shape: Shape, width: int = 2048) -> np.ndarray:
    """Mean probabilities of each text, texts standing one after another in data; zeros for an empty one."""
    size = np.diff(offsets)
    pieces = -(-size // shape.stretch)
    row = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[row] + nth * shape.stretch
    for _ in range(3):  # a stretch starts where a character does
        inside = (nth > 0) & (data[begin] & 0xC0 == 0x80) if len(begin) else nth > 0
        begin = begin - inside
    length = np.append(begin[1:], offsets[-1]) - begin
    sums = np.zeros((len(size), len(w["o"])))
    by_length = np.argsort(length, kind="stable")
    padded = np.concatenate([data, np.zeros(shape.stretch + 3, np.uint8)])
    for i in range(0, len(row), width):
        some = by_length[i : i + width]
        steps = int(length[some].max())
        at = np.arange(steps)[:, None]
        block = np.where(at < length[some], padded[begin[some] + at], 0).astype(np.uint8)
        np.add.at(sums, row[some], position_sums(w, block, length[some]))
    return sums / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, shape: Shape) -> list[tuple[str, bytes]]:
    """(language, text) of the sampled rows: of each language those with the least hash of id, text and language, whatever the partitions.

    Equal rows count once. Each language has the same number of rows and bytes, so that a rare one is learned from all its rows. A
    first look takes rows under a hash bound that should let through twice as many as are needed; a language of which it
    shows too few, as where most of its rows are equal, is looked at again without a bound.
    """
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    count = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return []
    quota, most = -(-shape.rows // len(count)), shape.sample_bytes // len(count)
    mark = F.xxhash64(F.lit(shape.seed), "doc_id", "text", "lang")
    rows = labelled.select("lang", mark.alias("mark"), F.shiftrightunsigned(mark, 24).alias("place"), "text", F.octet_length("text").cast("long").alias("size"))

    def least(languages: dict[str, int]) -> list:
        """Of each language the rows up to its quota of those whose place is at most its bound."""
        bound = F.lit(-1)
        for lang, most_place in languages.items():
            bound = F.when(F.col("lang") == lang, F.lit(most_place)).otherwise(bound)
        once = rows.where(F.col("place") <= bound).groupBy("lang", "place", "mark").agg(F.first("size").alias("size"))
        order = Window.partitionBy("lang").orderBy("place", "mark")
        ranked = once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= quota)
        taken = ranked.withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") < most).select(F.col("lang").alias("_l"), F.col("mark").alias("_m"))
        found = rows.where(F.col("place") <= bound).join(F.broadcast(taken), (F.col("lang") == F.col("_l")) & (F.col("mark") == F.col("_m")))
        return found.groupBy("lang", "mark").agg(F.first("text").alias("text")).orderBy("lang", "mark").collect()

    every = 1 << 40
    bounds = {lang: min(every, 2 * every * quota // n) for lang, n in count.items()}
    out = least(bounds)
    had = Counter(r["lang"] for r in out)
    few = {lang: every for lang in count if bounds[lang] < every and had[lang] < quota and sum(len(r["text"].encode()) for r in out if r["lang"] == lang) < most}
    if few:
        out = [r for r in out if r["lang"] not in few] + least(few)
    return [(r["lang"], r["text"].encode()) for r in out]


def identify(docs: DataFrame, shape: Shape = Shape(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, held_out, lang_pred, score for each document."""
    found = sample(docs, shape)
    languages = sorted({x for x, _ in found})
    label = np.array([languages.index(x) for x, _ in found], np.int64)
    w = train([x for _, x in found], label, len(languages), shape) if languages else None
    release()
    schema = docs.select(*keep).schema
    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), F.when(letters, F.col("text")).alias("_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = Texts(batch.column("_text")), [], []
            for a, z in texts.groups():
                data, at = texts.bytes(a, z)
                p = probabilities(w, data, at, shape) if languages else np.zeros((z - a, 1))
                best = p.argmax(1)
                known = (np.diff(at) > 0) & bool(languages)
                names += [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores.append(np.where(known, np.minimum(p[np.arange(z - a), best], 1.0), 0.0))
            kept = [batch.column(c) for c in (*keep, "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.concatenate([*scores, np.empty(0)]))], [*keep, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tidy(each), full)


def known(docs: DataFrame, least: float = 0.5, shape: Shape | None = None) -> DataFrame:
    """``docs`` without the documents whose language isn't known at a score of ``least``."""
    names = docs.columns
    packed = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names])).select("_row", "doc_id", "text", "lang")
    out = identify(packed, shape or Shape(), ("_row",))
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col("_row").getField(c).alias(c) for c in names])
