"""Language identification by a byte convolutional network trained in numpy.

A text is lower-cased over A-Z, encoded as UTF-8 and cut into windows of a fixed number of bytes, the last
one padded with zero bytes. In each window, filters of several widths slide over the byte embeddings, the
largest response of each filter is kept, and a softmax layer turns those into language probabilities. A
document's probabilities are the mean of its windows', weighted by the bytes they hold, so a text of any
length is read whole.

Since the first layer is linear in the bytes' embeddings, a filter's response is a sum of table entries,
one for each pair of neighbouring bytes; predictions look these up in batches of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
SLAB = 64  # windows that are convolved together
NO_LANGUAGE = "und"


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBEDDING
    conv: np.ndarray  # width x EMBEDDING x filters, zero beyond a filter's own width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> np.ndarray:
        """For each place in a filter, the responses to each byte."""
        return np.einsum("be,kef->kbf", self.embed, self.conv).astype(np.float32)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The responses to the first and the second pair of bytes of a filter."""
        t = self.tables()
        return tuple((t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in (0, 2))


def windows(raw: bytes) -> np.ndarray:
    """The windows of one text as rows of bytes; none for an empty text."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _pair_codes(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), WINDOW + 3), dtype=np.uint16)
    wide[:, :WINDOW] = rows
    return wide[:, :-1] * np.uint16(256) + wide[:, 1:]


def pooled(rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    codes = _pair_codes(rows)
    response = first[codes[:, :WINDOW]]
    response += second[codes[:, 2 : WINDOW + 2]]
    return response.max(axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes]], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Fits the network to (language, bytes of a window) samples by Adam. The result depends on them only."""
    langs = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    fits = np.zeros((max(WIDTHS), 1, n_filters))
    for i, width in enumerate(WIDTHS):
        fits[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
        "conv": rng.normal(0, 0.3, (max(WIDTHS), EMBEDDING, n_filters)) * fits,
        "bias": np.zeros(n_filters),
        "out": rng.normal(0, 0.1, (n_filters, len(langs))),
        "out_bias": np.zeros(len(langs)),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    xs = []
    for _, raw in samples:
        n = len(raw) if rng.random() < 0.6 else min(len(raw), int(rng.integers(6, 96)))
        xs.append(np.frombuffer(raw[:n].ljust(WINDOW, b"\0")[:WINDOW], dtype=np.uint8))
    x, y = np.stack(xs), np.array([number[lang] for lang, _ in samples])
    weight = len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            part = order[at : at + batch]
            rows, want = x[part], y[part]
            table = np.einsum("be,kef->kbf", p["embed"], p["conv"]).astype(np.float32)
            wide = np.zeros((len(rows), WINDOW + 3), dtype=np.uint8)
            wide[:, :WINDOW] = rows
            response = table[0][wide[:, :WINDOW]]
            for k in range(1, len(table)):
                response += table[k][wide[:, k : k + WINDOW]]
            where = response.argmax(axis=1)
            best = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + p["bias"]
            hidden = np.maximum(best, 0)
            prob = softmax(hidden @ p["out"] + p["out_bias"])
            slope = prob
            slope[np.arange(len(want)), want] -= 1
            slope *= (weight[want] / len(want))[:, None]
            back = (slope @ p["out"].T) * (best > 0)
            g = {"out": hidden.T @ slope, "out_bias": slope.sum(axis=0), "bias": back.sum(axis=0)}
            d_table = np.zeros_like(table, dtype=np.float64)
            lanes = np.broadcast_to(np.arange(n_filters), where.shape)
            for k in range(len(table)):
                np.add.at(d_table[k], (np.take_along_axis(wide, where + k, axis=1), lanes), back)
            d_table *= fits
            g["embed"] = np.einsum("kbf,kef->be", d_table, p["conv"])
            g["conv"] = np.einsum("kbf,be->kef", d_table, p["embed"])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(langs, *(p[k].astype(np.float32) for k in ("embed", "conv", "bias", "out", "out_bias")))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def classify(model: Model, pairs: tuple[np.ndarray, np.ndarray], texts: list[str | None]) -> list[tuple[str, float]]:
    """The language and its probability for each text; ``und`` and 0 for a text without letters."""
    if not model.langs:
        return [(NO_LANGUAGE, 0.0)] * len(texts)
    held: list[np.ndarray] = []
    owner: list[int] = []
    share: list[float] = []
    total = np.zeros((len(texts), len(model.langs)))

    def flush() -> None:
        if held:
            best = pooled(np.concatenate(held), *pairs) + model.bias
            prob = softmax(np.maximum(best, 0) @ model.out + model.out_bias)
            np.add.at(total, owner, prob * np.array(share)[:, None])
            held.clear(), owner.clear(), share.clear()

    letters = [has_letter(t) for t in texts]
    for i, text in enumerate(texts):
        if letters[i]:
            raw = text.encode("utf-8", "surrogatepass").lower()
            for at in range(0, len(raw), WINDOW * SLAB):
                piece = raw[at : at + WINDOW * SLAB]
                rows = windows(piece)
                held.append(rows)
                owner += [i] * len(rows)
                share += [WINDOW / len(raw)] * (len(rows) - 1) + [(len(piece) - WINDOW * (len(rows) - 1)) / len(raw)]
                if len(owner) >= SLAB:
                    flush()
    flush()
    return [
        (model.langs[b], min(1.0, float(total[i, b]))) if letters[i] else (NO_LANGUAGE, 0.0)
        for i, b in enumerate(total.argmax(axis=1).tolist())
    ]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_docs: int = 3200,
    sample_windows: int = 4,
) -> Model:
    """Trains on the labelled rows of ``docs`` that are not held out.

    The fit uses a bounded sample: about ``sample_docs`` documents over all languages, the same number of
    each if there are enough, chosen by a hash of id and text, and ``sample_windows`` windows from each at
    hashed places. Only these windows come to the driver. The languages themselves are counted over all rows.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return Model([], *(np.zeros((1, 1), dtype=np.float32) for _ in range(5)))
    each = max(20, sample_docs // len(counts))
    spread = 1 << 30
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(spread * min(1.0, 1.2 * each / n)))])
    size = F.char_length(text)
    cut = [
        F.substring(F.col(text), F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), F.greatest(size - WINDOW + 1, F.lit(1))).cast("int") + 1, F.lit(WINDOW))
        for k in range(sample_windows)
    ]
    rows = (
        known.withColumn("_draw", F.xxhash64(F.col(doc_id), F.col(text)))
        .where(F.pmod("_draw", F.lit(spread)) < limit[F.col(lang)])
        .where(F.col(text).rlike(r"\p{L}"))
        .select(F.col(lang).alias("lang"), "_draw", F.array_distinct(F.array(*cut)).alias("cuts"))
        .collect()
    )
    rows.sort(key=lambda r: (r[0], r[1]))
    taken: dict[str, int] = {}
    samples = []
    for name, _, cuts in rows:
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= each:
            samples += [(name, c.encode("utf-8", "surrogatepass").lower()[:WINDOW]) for c in cuts if has_letter(c)]
    if not samples:
        return Model([], *(np.zeros((1, 1), dtype=np.float32) for _ in range(5)))
    return train(samples)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns (doc_id, lang_pred, score) for every row of ``docs``, from its text alone.

    With ``keep``, these columns come through unchanged in place of the id. Null texts and texts without
    letters are ``und`` with score 0, and so is every text if nothing was learned. Ties go to the language
    that sorts first. Repeated rows stay repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text")) if keep is None
            else docs.select(*keep, F.col(text).cast("string").alias("_text")))
    names = [c for c in kept.columns if c != "_text"]
    schema = T.StructType([*(f for f in kept.schema if f.name != "_text"), *T.StructType.fromDDL("lang_pred string, score double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        pairs = own.pairs() if own.langs else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = classify(own, pairs, [x.as_py() for x in part.column("_text")])
                columns = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
