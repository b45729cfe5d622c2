"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words.  Each passage is encoded from
its bytes and words; gated attention weighs the passages of a text, and the
weighted mean of their codes is scored.  Only texts are labelled: the weights of
passages are learnt from them, so a spoilt passage in a long text can decide.

Encoding, attention and score run over whole texts on the executors; training
runs on the driver over a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .runtime import bare, named, place, ship, written
from .words import BASES, U, mix, power_tables

WORDS = 64
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "stop": b".?!",
    "bang": b"!",
    "pause": b",;:",
    "other": b"\"'()[]{}=+-_/\\@^~`",
    "high": range(128, 256),
    "line": b"\n",
}
_N_HASHED = 16
N_FEATURES = len(_CLASSES) + 9 + _N_HASHED
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_TABLE = np.zeros((len(_CLASSES), 256), np.int32)
for _k, _c in enumerate(_CLASSES.values()):
    _TABLE[_k, list(_c)] = 1


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, owner): a row for each passage, and the number of its text.

    Every text has at least one passage; one without words has zeros.  Texts are
    laid end to end, so that numpy sees long arrays however short they are.
    """
    raw = [(t or b"") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edge = np.cumsum([0, *map(len, raw)])
    space = _SPACE[data]
    change = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, stop = change[0::2], change[1::2]
    doc = np.searchsorted(edge, start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(raw)))  # a text's first word
    inner = np.arange(len(start)) - first[doc]
    words_of = np.diff(np.append(first, len(start)))
    passages_of = np.maximum(1, -(-words_of // WORDS))
    base = np.concatenate(([0], np.cumsum(passages_of)))
    owner = np.repeat(np.arange(len(raw)), passages_of)
    at = base[doc] + inner // WORDS
    n = int(base[-1])
    out = np.zeros((n, N_FEATURES), np.float64)
    if not len(start):
        return out, owner
    count = np.bincount(at, minlength=n)
    some = np.maximum(count, 1)
    length = stop - start
    chars = np.maximum(np.bincount(at, length, n), 1)
    # bytes by class, from running counts at the first byte of each passage
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    lo = start[begin]
    hi = np.concatenate((lo[1:], [len(data)]))
    hi = np.minimum(hi, edge[doc[begin] + 1])
    for k in range(len(_CLASSES)):
        sums = np.concatenate(([0], np.cumsum(_TABLE[k][data])))
        out[at[begin], k] = sums[hi] - sums[lo]
    out[:, : len(_CLASSES)] /= chars[:, None]
    k = len(_CLASSES)
    mean = chars / some
    out[:, k] = mean
    out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(at, length.astype(float) ** 2, n) / some - mean**2))
    out[:, k + 2] = np.log1p(count)
    longest = np.zeros(n)
    np.maximum.at(longest, at, length)
    out[:, k + 3] = np.log1p(longest)
    up, down = power_tables(BASES[0], len(data) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])))
    word = mix((sums[stop] - sums[start]) * down[start])
    same = np.concatenate(([False], word[1:] == word[:-1])) & (inner > 0)
    out[:, k + 4] = np.bincount(at, same, n) / some
    order = np.lexsort((word, at))
    fresh = np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (at[order][1:] != at[order][:-1])))
    out[:, k + 5] = np.bincount(at[order], fresh, n) / some
    ends = data[stop - 1]
    out[:, k + 6] = np.bincount(at, (ends == 33), n) / some
    out[:, k + 7] = np.bincount(at, _TABLE[3][ends], n) / some
    out[:, k + 8] = np.bincount(at, length <= 3, n) / some
    hashed = np.bincount(at * _N_HASHED + (word >> U(60)).astype(np.int64), minlength=n * _N_HASHED)
    out[:, k + 9 :] = hashed.reshape(n, _N_HASHED) / some[:, None]
    out[count == 0] = 0
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(model: dict, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
    """Codes, attention weights (they sum to 1 in a text) and scores."""
    h = np.tanh(((x - model["mean"]) / model["sd"]).clip(-8, 8) @ model["W"] + model["b"])
    t, s = np.tanh(h @ model["V"]), _sigmoid(h @ model["Q"])
    g = t * s
    logit = g @ model["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logit)
    a = np.exp(logit - top[owner])
    a /= np.bincount(owner, a, n)[owner]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, owner, a[:, None] * h)
    return {"h": h, "t": t, "s": s, "g": g, "a": a, "z": z, "p": _sigmoid(z @ model["c"] + model["c0"])}


def gradients(m: dict, x: np.ndarray, seg: np.ndarray, y: np.ndarray) -> dict:
    """Gradient of the mean log loss over the texts with labels ``y``."""
    xs = ((x - m["mean"]) / m["sd"]).clip(-8, 8)
    f = forward(m, x, seg, len(y))
    do = (f["p"] - y) / len(y)
    dz = do[:, None] * m["c"][None, :]
    dh = f["a"][:, None] * dz[seg]
    da = (f["h"] * dz[seg]).sum(axis=1)
    dl = f["a"] * (da - np.bincount(seg, f["a"] * da, len(y))[seg])
    dg = dl[:, None] * m["w"][None, :]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ m["V"].T + ds @ m["Q"].T
    du = dh * (1 - f["h"] ** 2)
    return {
        "W": xs.T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "Q": f["h"].T @ ds,
        "w": f["g"].T @ dl, "c": f["z"].T @ do, "c0": do.sum(keepdims=True),
    }


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, *, code: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> dict:
    """Gated attention network by Adam on the log loss; deterministic.

    With no text, or labels all alike, the score is that share everywhere.
    """
    rng = np.random.default_rng(seed)
    d, n = x.shape[1], len(y)
    m = {
        "mean": x.mean(axis=0) if n else np.zeros(d), "sd": (x.std(axis=0) if n else np.zeros(d)) + 1e-6,
        "W": rng.normal(0, d**-0.5, (d, code)), "b": np.zeros(code),
        "V": rng.normal(0, code**-0.5, (code, gate)), "Q": rng.normal(0, code**-0.5, (code, gate)),
        "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, code**-0.5, code), "c0": np.zeros(1),
    }
    share = (y.sum() + 1) / (n + 2)
    m["c0"][0] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        m["c"][:] = 0
        return m
    names = ["W", "b", "V", "Q", "w", "c", "c0"]
    first = {k: np.zeros_like(m[k]) for k in names}
    second = {k: np.zeros_like(m[k]) for k in names}
    edge = np.searchsorted(owner, np.arange(n + 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            docs = order[at : at + batch]
            sizes = edge[docs + 1] - edge[docs]
            rows = np.repeat(edge[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            seg = np.repeat(np.arange(len(docs)), sizes)
            grads = gradients(m, x[rows], seg, y[docs])
            step += 1
            for k in names:
                g = grads[k] + decay * m[k] * (m[k].ndim > 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(id_column: Column) -> Column:
    """Every fifth id by the CRC-32 of its decimal text; a null id is empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *,
    max_rows: int = 4000, max_bytes: int = 1 << 18, max_total: int = 1 << 26, **params,
) -> dict:
    """Train on at most ``max_rows`` labelled texts of at most ``max_bytes`` each
    and ``max_total`` together.

    The sample is bounded by these parameters: the labelled ids that are not
    held out, in the order of a hash of the id, the first ``max_rows`` of them,
    as far as their texts go into ``max_total``; the features that reach the
    driver take less room than the texts.  An id with several labels has the
    least, an id with several texts the one with the least hash; ids or labels
    that are null, and labelled ids without a text, are left out.
    """
    ship(docs.sparkSession)
    known = bare(labels).select(place(labels, id_col).alias("_id"), place(labels, label_col).cast("int").alias("_y"))
    known = known.filter("_id is not null and _y is not null").filter(~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = bare(docs).select(place(docs, id_col).alias("_id"), place(docs, text_col).cast("binary").alias("_t")).join(F.broadcast(chosen), "_id")  # max_rows at most
    rows = rows.withColumn("_size", F.coalesce(F.octet_length("_t"), F.lit(0))).filter(F.col("_size") <= max_bytes)
    one = rows.groupBy("_id", "_y").agg(F.min_by(F.struct("_t", "_size"), F.xxhash64("_t")).alias("_x"))
    one = written(one.select("_id", "_y", "_x._t", "_x._size"), "mil-sample")
    ahead = Window.orderBy(F.xxhash64("_id"), "_id")  # over max_rows small rows
    room = one.select("_id", F.sum("_size").over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum")).filter(F.col("_sum") <= max_total)
    sample = one.join(F.broadcast(room.select("_id")), "_id").select("_id", "_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, owner = encode(b.column(2).to_pylist())
            parts = [part.tobytes() for part in np.split(x, np.searchsorted(owner, np.arange(1, b.num_rows)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.binary())], names=["_id", "_y", "_x"])

    schema = f"_id {sample.schema['_id'].dataType.simpleString()}, _y int, _x binary"
    found = sample.mapInArrow(run, schema).toArrow()
    order = sorted(range(found.num_rows), key=lambda k: str(found["_id"][k].as_py()))  # any order of tasks gives one model
    xs = [np.frombuffer(found["_x"][k].as_py()).reshape(-1, N_FEATURES) for k in order]
    x = np.concatenate(xs) if xs else np.zeros((0, N_FEATURES))
    owner = np.repeat(np.arange(len(xs)), [len(v) for v in xs])
    return train(x, owner, np.array([float(found["_y"][k].as_py() == 1) for k in order]), **params)


def score(docs: DataFrame, model: dict, text_col: str = "text", *, attention: bool = False, batch: int = 256) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, of every whole text; with
    ``attention`` also ``top_passage``, the number of the heaviest passage (the
    first of equal ones).

    A null text is empty: one passage without words.  Only the text is read for
    the score.  Rows come back one for one; input columns of the added names are
    replaced, other names are free; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    added = ["score", *(["top_passage"] if attention else [])]
    kept = [k for k, c in enumerate(docs.columns) if c not in added]
    rows = bare(docs).select(*[f"c{k}" for k in kept], place(docs, text_col).cast("binary").alias("_text"))
    carried = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                x, owner = encode(b.column(b.num_columns - 1).to_pylist())
                f = forward(model, x, owner, b.num_rows)
                arrays = [*b.columns[:-1], pa.array(np.round(f["p"], 9))]
                if attention:
                    edge = np.searchsorted(owner, np.arange(b.num_rows + 1))
                    arrays.append(pa.array([int(f["a"][i:j].argmax()) for i, j in zip(edge, edge[1:], strict=False)], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *added])

    kinds = [StructField("score", DoubleType()), *([StructField("top_passage", LongType())] if attention else [])]
    out = rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *kinds]))
    return named(out, [*[docs.columns[k] for k in kept], *added])
