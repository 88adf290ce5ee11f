"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words. Every text is cut into them once and stored as hashes of its different words and their places. The
most frequent words of the corpus are classes of their own, all others share a fixed number of hashed classes, so a
token is one byte and the corpus is stored as one byte string a document. The network sees the embeddings of the
tokens on both sides of a place, not the token itself. A hidden layer and two softmaxes, over groups of classes and
over the classes of the group, give the probability of that token's class. Within a hashed class a word's probability
is its share of the class's words in the corpus: the counts of all words are a table that grows with the corpus, and
every document's words of hashed classes are joined with it. A document's score is the sum of the logarithms of both
over all its tokens.

Training is data-parallel and sees every place once. In each round every task starts from the same weights and runs
exact gradient steps over a third of the places that it reads; the new weights are averaged by Spark, weighted by the
places they saw, and become the next round's start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import written

WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")  # runs of letters and digits, other signs one by one
WORDS_WITHOUT_LINES = re.compile(r"\w+|[^\w\s]")  # finds the same in texts without a low line, in half the time
KNOWN, HASHED = 224, 32
CLASSES = KNOWN + HASHED  # a token fits one byte
GROUPS = 8  # of the classes, in the order of their frequency; the hashed ones come last
IN_GROUP = CLASSES // GROUPS
EDGE = CLASSES  # stands beyond both ends of a text
SIDE = 2
EMBEDDING, HIDDEN = 16, 32
ROUNDS = 3
EVERY = 3  # of each document's places, one of so many is used in a round
BATCH = 2048
RATE = 0.2
SCORED = 4096  # places whose likelihoods are computed at once
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[list[str]]:
    """The tokens of a text, piece by piece, cut at white space."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        piece = text[start:end].lower()
        yield (WORDS if "_" in piece else WORDS_WITHOUT_LINES).findall(piece)
        start = end


def split(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, places, hashes, counts): every text cut into tokens, once for all that follows.

    ``hashes`` and ``counts`` are the different words of a text, by Spark's xxhash64, and how often each is seen;
    ``places`` gives for every token its index among them, in two bytes if these suffice, else in four. ``row`` tells
    rows apart. All are empty for null texts and texts without tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hashes, counts, ends = [], [], [], [0]
            for value in batch.column(2):
                seen: dict[str, int] = {}
                parts = [
                    np.fromiter([seen.setdefault(word, len(seen)) for word in found], dtype=np.uint32, count=len(found))
                    for found in _pieces(value.as_py() or "")
                ]
                places = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                out.append(places.astype(_width(len(seen))).tobytes())
                hashes.append(np.fromiter([xxhash.xxh64_intdigest(word, 42) for word in seen], dtype=np.uint64, count=len(seen)).view(np.int64))
                counts.append(np.bincount(places, minlength=len(seen)))
                ends.append(ends[-1] + len(seen))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(np.int64))) for x in (hashes, counts)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), *lists], ["row", "doc_id", "places", "hashes", "counts"])

    kept = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, "row long, doc_id long, places binary, hashes array<long>, counts array<long>")


def _width(different: int) -> type:
    return np.uint16 if different <= 1 << 16 else np.uint32


def word_counts(cut: DataFrame) -> DataFrame:
    """(hash, n) of all words of all texts that :func:`split` has cut."""
    used = cut.select(F.explode(F.arrays_zip("hashes", "counts")).alias("u"))
    return used.groupBy(F.col("u.hashes").alias("hash")).agg(F.sum("u.counts").alias("n"))


def vocabulary(counts: DataFrame) -> list[int]:
    """The hashes of the most frequent words; ties go to the least hash."""
    return [r[0] for r in counts.orderBy(F.desc("n"), "hash").limit(KNOWN).collect()]


def shared_classes(counts: DataFrame, words: list[int]) -> tuple[DataFrame, np.ndarray]:
    """(hash, n) of the words of hashed classes that are seen more than once, and the number of words seen in each class."""
    rest = counts.where(~F.col("hash").isin(words)) if words else counts
    sizes = np.ones(CLASSES)
    for number, n in rest.groupBy((F.col("hash").bitwiseAND(F.lit(HASHED - 1).cast("long"))).alias("k")).agg(F.sum("n")).collect():  # HASHED rows
        sizes[KNOWN + number] = n
    return rest.where("n > 1"), sizes


def tokens(cut: DataFrame, words: list[int]) -> DataFrame:
    """(row, doc_id, tokens): the class of every token, one byte for each, from a table of :func:`split`."""
    known = np.sort(np.array(words, dtype=np.int64))
    number = np.argsort(np.array(words, dtype=np.int64)).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(3).flatten().to_numpy()
            classes = (KNOWN + (hashes & (HASHED - 1))).astype(np.uint8)
            if words:
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                classes = np.where(known[at] == hashes, number[at], classes)
            lengths, start, out = batch.column(3).value_lengths().to_pylist(), 0, []
            for value, length in zip(batch.column(2), lengths):
                out.append(classes[start : start + length][np.frombuffer(value.as_py(), dtype=_width(length))].tobytes())
                start += length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "doc_id", "tokens"])

    return cut.select("row", "doc_id", "places", "hashes").mapInArrow(run, "row long, doc_id long, tokens binary")


class Network:
    """The weights as one flat array and views of it. A class is a group and a place in it, each with its own softmax."""

    SHAPES = ((CLASSES + 1, EMBEDDING), (2 * SIDE * EMBEDDING, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, IN_GROUP), (GROUPS, IN_GROUP))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray | None = None, seed: int = 11, views_of: np.ndarray | None = None):
        if views_of is None and flat is None:
            rng = np.random.default_rng(seed)
            deep = 1 / np.sqrt(HIDDEN)
            scale = (0.3, 1 / np.sqrt(2 * SIDE * EMBEDDING), 0, deep, 0, deep, 0)
            flat = np.concatenate([(rng.normal(0, 1, s) * k).ravel() for s, k in zip(self.SHAPES, scale)])
        self.flat = flat.astype(np.float32) if views_of is None else views_of
        at, views = 0, []
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            views.append(self.flat[at : at + n].reshape(shape))
            at += n
        self.embed, self.inner, self.inner_bias, self.group, self.group_bias, self.outer, self.outer_bias = views

    def prepared(self) -> Network:
        """Keeps what does not change while only scoring: each side's words already through the inner layer."""
        cut = self.inner.reshape(2 * SIDE, EMBEDDING, HIDDEN)
        self.sides = [np.ascontiguousarray(self.embed @ c) for c in cut]
        self.sides[0] += self.inner_bias
        return self

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each place's class: the logarithms of its group's probability and of its own within the group, added."""
        order = np.argsort(target.astype(np.uint8), kind="stable")
        context, target = context.take(order, axis=0), target.take(order)
        group, own = target // IN_GROUP, target % IN_GROUP
        hidden = self.sides[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            hidden += self.sides[k].take(context[:, k], axis=0)
        np.tanh(hidden, out=hidden)
        at = np.arange(len(order))
        top = hidden @ self.group + self.group_bias
        inside = self.inside(hidden, group)
        found = np.empty(len(order), dtype=np.float32)
        found[order] = _log_of(top, at, group) + _log_of(inside, at, own)
        return found

    def inside(self, hidden: np.ndarray, group: np.ndarray, logits: np.ndarray | None = None) -> np.ndarray:
        """The logits within each place's group; places come in the order of their groups."""
        logits = np.empty((len(group), IN_GROUP), dtype=np.float32) if logits is None else logits
        for g, first, after in _runs(group):
            np.matmul(hidden[first:after], self.outer[g], out=logits[first:after])
        logits += self.outer_bias[group]
        return logits

    def gradient(self) -> Network:
        """A network of zeros, the same one at every call."""
        if not hasattr(self, "slopes"):
            self.slopes = Network(views_of=np.empty(self.SIZE, dtype=np.float32))
        self.slopes.flat.fill(0)
        return self.slopes

    def buffers(self, n: int) -> list[np.ndarray]:
        """Room for the steps of a batch of ``n`` places, the same one for all batches up to the largest so far."""
        if len(getattr(self, "room", [()])[0]) < n:
            self.room = [np.empty((n, width), dtype=np.float32) for width in (2 * SIDE * EMBEDDING, HIDDEN, HIDDEN, HIDDEN, IN_GROUP)]
            self.step = np.empty(self.SIZE, dtype=np.float32)
        return [x[:n] for x in self.room]


def _runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, first, after) of the groups that occur in a sorted array."""
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return [(g, first, after) for g, (first, after) in enumerate(zip(ends, ends[1:])) if first < after]


def _finite(logits: np.ndarray) -> np.ndarray:
    """Shifts, in place, the rows of logits if any of their exponentials might not be finite or all vanish."""
    if logits.size and (logits.max() > 80 or logits.min() < -80):
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of all logits, in their place, and the sum of every row."""
    np.exp(_finite(logits), out=logits)
    return logits, logits @ np.ones(logits.shape[1], dtype=np.float32)


def _log_of(logits: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax at ``own``; overwrites the logits."""
    mine = _finite(logits)[at, own]
    return mine - np.log(_exponentials(logits)[1])


def contexts(ids: np.ndarray, first: int = 0, every: int = 1) -> np.ndarray:
    """The tokens on both sides of every place of a text, or of each so many from ``first`` on."""
    wide = np.full(len(ids) + 2 * SIDE, EDGE, dtype=np.intp)
    wide[SIDE : SIDE + len(ids)] = ids
    return np.stack([wide[k + first : k + len(ids) : every] for k in range(2 * SIDE + 1) if k != SIDE], axis=1)


def train_steps(net: Network, context: np.ndarray, target: np.ndarray, squares: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on a batch of places along the exact gradient of both softmaxes.

    The large arrays are the network's own and written anew at every call; fresh ones would cost as much again.
    """
    n = len(target)
    order = np.argsort(target.astype(np.uint8), kind="stable")
    context, target = context.take(order, axis=0), target.take(order)
    group, own = target // IN_GROUP, target % IN_GROUP
    at = np.arange(n)
    to = net.gradient()
    looked, hidden, back, other, inside = net.buffers(n)
    net.embed.take(context.ravel(), axis=0, out=looked.reshape(-1, EMBEDDING), mode="clip")
    np.matmul(looked, net.inner, out=hidden)
    hidden += net.inner_bias
    np.tanh(hidden, out=hidden)

    top = _slope(hidden @ net.group + net.group_bias, at, group)
    np.matmul(hidden.T, top, out=to.group)
    top.sum(axis=0, out=to.group_bias)
    np.matmul(top, net.group.T, out=back)

    _slope(net.inside(hidden, group, inside), at, own)
    for g, first, after in _runs(group):
        np.matmul(hidden[first:after].T, inside[first:after], out=to.outer[g])
        inside[first:after].sum(axis=0, out=to.outer_bias[g])
        back[first:after] += np.matmul(inside[first:after], net.outer[g].T, out=other[first:after])

    np.multiply(hidden, hidden, out=hidden)
    np.subtract(1, hidden, out=hidden)
    back *= hidden
    np.matmul(looked.T, back, out=to.inner)
    back.sum(axis=0, out=to.inner_bias)
    at_words = np.matmul(net.inner, back.T, out=looked.reshape(-1, n)).reshape(2 * SIDE, EMBEDDING, n)
    seen = context.T.ravel()
    for k in range(EMBEDDING):
        to.embed[:, k] = np.bincount(seen, weights=at_words[:, k].ravel(), minlength=CLASSES + 1)
    np.multiply(to.flat, to.flat, out=net.step)
    squares += net.step
    np.sqrt(squares, out=net.step)
    to.flat *= np.float32(rate)
    to.flat /= net.step
    net.flat -= to.flat


def _slope(logits: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The gradient of the mean loss by the logits, which it overwrites."""
    slope, total = _exponentials(logits)
    each = np.float32(1 / len(own))
    slope *= (each / total)[:, None]
    slope[at, own] -= each
    return slope


def fit(corpus: DataFrame, rounds: int = ROUNDS, every: int = EVERY) -> np.ndarray:
    """The weights after training on the stored tokens of the whole corpus."""
    weights = Network().flat
    for turn in range(rounds):
        start = corpus.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            net = Network(start.value.copy())
            squares = np.full(Network.SIZE, 0.01 * (turn + 1), dtype=np.float32)
            seen, held, size = 0, [], 0
            for batch in batches:
                for key, value in zip(batch.column(0), batch.column(1)):
                    ids = np.frombuffer(value.as_py() or b"", dtype=np.uint8)
                    first = ((key.as_py() or 0) + turn) % every
                    if len(ids) > first:
                        held.append((contexts(ids, first, every), ids[first::every]))
                        size += len(held[-1][1])
                    if size >= 16 * BATCH:
                        seen += _train_held(net, held, squares)
                        held, size = [], 0
            if held:
                seen += _train_held(net, held, squares)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(Network.SIZE)), pa.array(net.flat.astype(np.float64) * seen), pa.array(np.full(Network.SIZE, seen))], ["i", "w", "n"]
                )

        moved = corpus.select("doc_id", "tokens").mapInArrow(run, "i long, w double, n long")
        mean = moved.groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()  # one row for each weight
        if not mean.num_rows:
            break
        weights = np.empty(Network.SIZE, dtype=np.float32)
        weights[mean.column("i").to_numpy()] = mean.column("w").to_numpy()
    return weights


def _train_held(net: Network, held: list, squares: np.ndarray) -> int:
    context = np.concatenate([c for c, _ in held])
    target = np.concatenate([t for _, t in held]).astype(np.int64)
    for at in range(0, len(target), BATCH):
        train_steps(net, context[at : at + BATCH], target[at : at + BATCH], squares)
    return len(target)


def score(corpus: DataFrame, weights: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """(row, doc_id, n_tokens, log_likelihood) for every row of stored tokens; no tokens have likelihood 0.

    The likelihood is that of the classes, as if every word of a hashed class were seen once among the class's ``sizes``.
    """
    sent = corpus.sparkSession.sparkContext.broadcast(weights)
    share = -np.log(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(sent.value).prepared()
        for batch in batches:
            docs = [np.frombuffer(x.as_py() or b"", dtype=np.uint8) for x in batch.column(2)]
            total = np.array([np.bincount(d, minlength=CLASSES) @ share for d in docs])
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            size = 0

            def flush() -> None:
                if held:
                    of = np.concatenate([np.full(len(t), i) for i, _, t in held])
                    logp = net.log_probabilities(np.concatenate([c for _, c, _ in held]), np.concatenate([t for _, _, t in held]))
                    total[:] += np.bincount(of, weights=logp, minlength=len(total))
                    held.clear()

            for i, ids in enumerate(docs):
                around = contexts(ids)
                for at in range(0, len(ids), SCORED):
                    held.append((i, around[at : at + SCORED], ids[at : at + SCORED].astype(np.int64)))
                    size += len(held[-1][2])
                    if size >= SCORED:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(d) for d in docs], pa.int64()), pa.array(total)], ["row", "doc_id", "n_tokens", "log_likelihood"]
            )

    return corpus.select("row", "doc_id", "tokens").mapInArrow(run, "row long, doc_id long, n_tokens long, log_likelihood double")


def with_words(scored: DataFrame, cut: DataFrame, counts: DataFrame, words: list[int]) -> DataFrame:
    """Adds to the likelihoods of the classes those of the words within them, from the table (hash, n) of all counts."""
    used = cut.select("row", F.explode(F.arrays_zip("hashes", "counts")).alias("u")).select("row", F.col("u.hashes").alias("hash"), F.col("u.counts").alias("times"))
    used = used.where(~F.col("hash").isin(words)) if words else used
    more = used.join(counts, "hash").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    rows = scored.join(more, "row", "left")
    return rows.select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))


def pseudo_likelihoods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on ``docs`` and scores them: (doc_id, n_tokens, log_likelihood, mean_log_likelihood).

    Null and empty texts have no tokens, likelihood 0 and a null mean. Equal texts have equal scores up to
    rounding. Repeated rows stay repeated; other columns are dropped, whatever their names. Of equally frequent words
    the one with the least hash is a class of its own; words are told apart by 64-bit hashes. Very long texts are cut
    into words piece by piece; their tokens, one byte each, are scored in blocks. An empty table gives an empty one. The weights depend slightly on how the
    rows are dealt to tasks.
    """
    cut = written(split(docs, doc_id, text), "cut-texts", "zstd")
    counts = written(word_counts(cut), "word-counts")
    words = vocabulary(counts)
    rest, sizes = shared_classes(counts, words)
    corpus = written(tokens(cut, words), "tokens")
    found = with_words(score(corpus, fit(corpus), sizes), cut, rest, words)
    return found.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
