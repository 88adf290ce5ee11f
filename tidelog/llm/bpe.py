"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file's path is a parameter. The driver reads it once and ships the merge table to the
tasks. In a task, the distinct words of many documents lie as symbols in one flat array. Each round
looks up all neighbouring pairs by binary search over the sorted pair keys, takes the lowest rank of
each word, and merges all its occurrences from left to right, until no word has a pair left to merge.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space when texts are normalized. Fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|\n|[^{SPACE}\p{{L}}\p{{N}}]+")
BREAK = regex.compile("[ \n]")
CHUNK = 1_000_000
CACHED_RUNS = 300_000
TOP = np.int32(np.iinfo(np.int32).max)
SPACES = regex.compile(f"[{SPACE}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space
#: Letters of later Unicode versions: with lower case in the library, those not letters for it, and both.
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
LATER_OTHER = "\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\U00016ea0-\U00016ed3"
LATER = regex.compile(f"[{LATER_OTHER}{''.join(map(chr, LATER_LOWER))}]")
LATER_WORDS = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATER_OTHER}]]+|\p{{N}}|\n|[[^{SPACE}\p{{L}}\p{{N}}]||[{LATER_OTHER}]]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches ``at`` of ``flat``, one after another."""
    size = size[at]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - (ends - size), size)]


class Codec:
    """The tables of one vocabulary and the numpy kernels over them."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        first_use = np.full(self.size, len(merges), dtype=np.int64)
        rank = np.arange(len(merges))
        for side in (left, right):
            np.minimum.at(first_use, side, rank)
        if (first_use[made] <= rank).any():
            raise ValueError("a merged symbol is used before it is made; whole-word rounds would not be exact")
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = (left * self.size + right)[order]
        self.rank, self.made = rank[order].astype(np.int32), made[order].astype(np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, int] = {}
        self.start = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    # -- words ---------------------------------------------------------------------------------

    @staticmethod
    def normalize(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if LATER.search(text):
                text = text.translate(LATER_LOWER)
        return text.lower()

    @staticmethod
    def runs(text: str) -> list[str]:
        """The runs of a text between white space, as it stands."""
        return SPACES.split(text) if ODD_SPACE.search(text) else text.split()

    def _words(self, runs: list[str]) -> list[str]:
        """The pre-tokens of all runs, a line feed (which no run holds) between two runs.

        A special token stands as itself after a NUL marker.
        """
        joined = "\n".join(runs)
        if not any(s in joined for s in self.special):
            return self._plain(joined)
        out: list[str] = []
        for part in self.split.split(joined):
            out += ["\0" + part] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        text = self.normalize(text)
        return (LATER_WORDS if not text.isascii() and LATER.search(text) else WORDS).findall(text)

    @staticmethod
    def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
        """A long text cut before white space, which no word crosses."""
        start = 0
        while len(text) - start > size:
            found = BREAK.search(text, start + size)
            while found and found.end() < len(text) and not text[found.end()].isascii():
                found = BREAK.search(text, found.end())
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:] if start else text

    # -- merging -------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key).astype(np.int32)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], TOP), at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in one flat array, and each word's length."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lens) - 1
        ends = ends[lens > 0]
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        done_sym, done_word = [], []
        same = np.append(word[1:] == word[:-1], False)[: len(sym)]
        rank, at = np.full(len(sym), TOP), np.zeros(len(sym), dtype=np.int32)  # of the pair that starts at i
        changed = np.flatnonzero(same)
        while len(sym):
            rank[changed], at[changed] = self._rank(sym[changed], sym[changed + 1])
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            live = np.repeat(best != TOP, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, at = sym[live], word[live], rank[live], at[live]
                sizes, best = sizes[best != TOP], best[best != TOP]
                if not len(sym):
                    break
            chosen = rank == np.repeat(best, sizes)
            if (chosen[1:] & chosen[:-1]).any():  # of each run of equal pairs every other one merges
                i = np.arange(len(chosen))
                begin = np.maximum.accumulate(np.where(chosen & np.append(True, ~chosen[:-1]), i, -1))
                chosen &= (i - begin) % 2 == 0
            where = np.flatnonzero(chosen)
            sym[where] = self.made[at[where]]
            stay = np.ones(len(sym), dtype=bool)
            stay[where + 1] = False
            sym, word, rank, at = sym[stay], word[stay], rank[stay], at[stay]
            where = where - np.arange(len(where))  # each merge before it took one symbol away
            rank[where] = TOP
            changed = np.concatenate((where[where > 0] - 1, where[where + 1 < len(sym)]))
            changed = changed[word[changed] == word[changed + 1]]
        if not done_word:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _learn(self, runs: list[str]) -> None:
        """Merges the words of runs that are new and keeps the runs' ids."""
        words = self._words(runs)
        new = list(dict.fromkeys(words))
        special = {i: self.special[w[1:]] for i, w in enumerate(new) if w[0] == "\0" and w[1:] in self.special}
        ids, lens = self.merge([w.encode("utf-8") if i not in special else b"" for i, w in enumerate(new)])
        starts = np.cumsum(lens) - lens
        for i, token in special.items():
            starts[i], lens[i] = len(ids), 1
            ids = np.append(ids, np.int32(token))
        number = dict(zip(new, range(len(new))))
        at = np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words))
        ends = at == number.get("\n", -1)
        of = np.cumsum(ends)[~ends]
        at = at[~ends]
        size = np.bincount(of, weights=lens[at], minlength=len(runs)).astype(np.int64)
        if len(size) != len(runs):
            raise ValueError("a run holds a line feed")
        self.cache.update(zip(runs, range(len(self.cache), len(self.cache) + len(runs))))
        self.flat = np.concatenate((self.flat, _gathered(ids, starts, lens, at)))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        found = [self.runs(t) for t in texts]
        every = [r for rs in found for r in rs]
        get = self.cache.get
        at = np.array([get(r, -1) for r in every], dtype=np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.cache) > CACHED_RUNS:
                self.cache, self.start, self.flat = {}, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
                missing = np.arange(len(every))
            self._learn(list(dict.fromkeys(every[i] for i in missing.tolist())))
            get = self.cache.__getitem__
            at[missing] = [get(every[i]) for i in missing.tolist()]
        size = self.start[1:] - self.start[:-1]
        ids = _gathered(self.flat, self.start, size, at)
        text = np.repeat(np.arange(len(texts)), [len(rs) for rs in found])
        lens = np.bincount(text, weights=size[at], minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(lens)[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' names joined by single spaces, as for a vocabulary without a decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def _groups(texts: Iterator[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of about CHUNK characters together, and how many pieces each text that ends there has."""
    pieces, counts, held, open_ = [], [], 0, 0
    for text in texts:
        for piece in Codec.pieces(text or ""):
            pieces.append(piece)
            held += len(piece)
            open_ += 1
        counts.append(open_)
        open_ = 0
        if held >= CHUNK:
            yield pieces, counts
            pieces, counts, held = [], [], 0
    if counts:
        yield pieces, counts


_codecs: dict[str, Codec] = {}


def _shipped(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    sent = spark.sparkContext.broadcast(spec)

    def codec() -> Codec:
        if path not in _codecs:
            _codecs[path] = Codec(json.loads(sent.value))
        return _codecs[path]

    return codec


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Returns (doc_id, n_tokens, ids[, decoded]); ``ids`` is binary, little-endian unsigned 32-bit integers.

    Null texts are encoded as empty ones. Every text is encoded whole: a very long one goes through in
    pieces cut before white space. With ``decoded`` the ids are decoded again in the same pass. Repeated
    rows stay repeated; other columns are dropped.
    """
    codec = _shipped(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            keys, at = batch.column(0), 0
            for pieces, counts in _groups(x.as_py() for x in batch.column(1)):
                parts, ids, i = own.encode(pieces), [], 0
                for n in counts:
                    ids.append(parts[i] if n == 1 else np.concatenate(parts[i : i + n]))
                    i += n
                out = [
                    keys.slice(at, len(counts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                ]
                if decoded:
                    out.append(pa.array([own.decode(x) for x in ids], pa.string()))
                at += len(counts)
                yield pa.RecordBatch.from_arrays(out, names)

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Returns (doc_id, decoded) from the binary ids that :func:`encode` gives; null ids decode to an empty text."""
    codec = _shipped(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [own.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kept = tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("binary").alias("ids"))
    return kept.mapInArrow(run, "doc_id long, decoded string")
