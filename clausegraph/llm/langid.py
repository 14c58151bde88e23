"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. The probabilities come from
expectation maximisation on a bounded sample. Pieces and words of any length take part; sums are kept as logarithms, and
of a word only the last characters' sums are held, so a word of any length passes in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.llm.common import let_go, slices, small_batches, text_buffer

#: Sampled documents per language, about, and their length in characters at most.
SAMPLE, SAMPLE_CHARS = 500, 20_000
UNKNOWN = 1e-7
#: Characters of a word whose pieces are looked up at once; characters of all words held so; bytes of forward sums held.
WINDOW, CELLS, SUMS = 4096, 1 << 18, 16 << 20
#: Shares of up to so many languages stand in the plan, more are joined.
LITERALS = 1000
MARK = "▁"
UNDETERMINED = "und"
_PART = np.zeros(256, bool)
_PART[65:91] = _PART[97:123] = _PART[128:] = True
_BASE = np.uint64(0x5851F42D4C957F2D)


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that can stand in lower-case words, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p and p == p.lower()})


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)


@dataclass
class Hits:
    """Pieces found in words: by row of the word, where the piece ends, its length and id; sorted by end, then row."""

    row: np.ndarray
    end: np.ndarray
    length: np.ndarray
    ids: np.ndarray


class Pieces:
    """Finds the pieces at every place of many words at once."""

    def __init__(self, pieces: list[str]):
        size = np.array([len(p) for p in pieces], np.int64)
        flat, begin = code_points(pieces), np.cumsum(size) - size
        keys = np.zeros(len(pieces), np.uint64)
        self.longest = int(size.max(initial=1))
        for k in range(self.longest):
            long = size > k
            keys[long] = self.more(keys[long], flat[begin[long] + k])
        order = np.argsort(keys)
        bits = 19
        table = np.zeros(1 << bits, np.int64)
        self.keys, self.table, self.shift = np.r_[np.uint64(0), keys[order]], table, np.uint64(64 - bits)
        slots = (self.keys >> self.shift).astype(np.int64)
        np.maximum.at(table, slots, np.arange(len(slots)))  # the last of those in a slot; they follow each other
        self.depth = int(np.bincount(slots).max())
        self.count = len(pieces)
        self.order = order

    @staticmethod
    def more(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = (keys ^ codes) * _BASE
        return x ^ (x >> np.uint64(29)) ^ (x << np.uint64(17))

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """1 + the piece's place in key order; 0: no piece."""
        at = self.table[(keys >> self.shift).astype(np.int64)]
        found = np.zeros(len(keys), np.int64)
        for _ in range(self.depth):
            found = np.where(self.keys[at] == keys, at, found)
            at = np.maximum(at - 1, 0)
        return found

    def hits(self, words: list[str], start: int) -> Hits:
        """Of words longer than ``start``: their pieces that end in the WINDOW characters after it. A lone character that is no
        piece has id -1, so some piece ends at every place."""
        low = max(0, start - self.longest + 1)
        parts = [w[low : start + WINDOW] for w in words]
        size = np.array([len(p) for p in parts], np.int64)
        flat, ends = code_points(parts), np.cumsum(size)
        row, at = np.repeat(np.arange(len(parts)), size), np.arange(len(flat))
        place = at - np.repeat(ends - size, size) + low
        stop, keys = np.repeat(ends, size), np.zeros(len(flat), np.uint64)
        found: list[tuple[np.ndarray, ...]] = []
        for n in range(1, self.longest + 1):
            inside = at + n <= stop[at]
            at, keys = at[inside], keys[inside]
            if len(at) == 0:
                break
            keys = self.more(keys, flat[at + n - 1])
            ids = self.ids(keys)
            if n == 1:
                ids[ids == 0] = -1
            hit = np.flatnonzero((ids != 0) & (place[at] + n > start))
            own = at[hit]
            found.append((row[own], place[own] + n, np.full(len(own), n), ids[hit]))
        row, end, length, ids = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(end * len(words) + row, kind="stable")
        return Hits(row[order], end[order], length[order], ids[order])


def runs(words: list[str], rows: int, cells: int) -> Iterator[np.ndarray]:
    """Places of words, longest first, in runs of at most ``rows`` words and ``cells`` characters (a window of a word counts)."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    k = 0
    while k < len(order):
        stop = k + max(1, min(rows, cells // max(1, min(len(words[order[k]]), WINDOW))))
        yield order[k:stop]
        k = stop


def summed(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Logarithms of sums over equal, ascending ``row``."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.logaddexp.reduceat(values, first, axis=0)


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray  # by id and language: row 0 unused, the last row for unknown characters
    level: np.ndarray  # by language: log-probability a character of the words it was learned from

    def finder(self) -> Pieces:
        if not hasattr(self, "_finder"):
            self._finder = Pieces(self.pieces)
        return self._finder

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": self.pieces, "probabilities": self.probabilities, "level": self.level}

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log-probability by word and language; no word may be empty."""
        finder, n = self.finder(), len(self.languages)
        out, log = np.zeros((len(words), n)), np.log(np.maximum(self.probabilities, 1e-300))
        deep = finder.longest
        for own in runs(words, max(1, SUMS // (8 * deep * n)), CELLS):
            texts = [words[i] for i in own]
            size = np.array([len(t) for t in texts])
            sums = np.zeros((len(own), deep, n))  # the sum to character e lies at e modulo the longest piece
            for start in range(0, int(size[0]), WINDOW):
                alive = int(np.searchsorted(-size, -start))
                h = finder.hits(texts[:alive], start)
                ends = np.arange(start + 1, min(start + WINDOW, int(size[0])) + 1)
                bounds = np.searchsorted(h.end, np.r_[ends, ends[-1] + 1])
                before = (h.end - h.length) % deep
                for e, a, b in zip(ends, bounds[:-1], bounds[1:], strict=True):
                    row = h.row[a:b]
                    now = summed(sums[row, before[a:b]] + log[h.ids[a:b]], row)
                    sums[: len(now), e % deep] = now
                    done = int(np.searchsorted(-size, -e))  # those longer than e go on
                    out[own[done : len(now)]] = now[done:]
        return out


def train(pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = 5) -> Model:
    """Piece probabilities by language from counts of marked words."""
    languages, finder = sorted(counts), Pieces(pieces)
    table = np.full((finder.count + 2, len(languages)), 0.0)
    level = np.zeros(len(languages))
    for k, language in enumerate(languages):
        words = sorted(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        p = np.full(finder.count + 2, 1.0 / max(1, finder.count))
        p[0], p[-1] = 0, UNKNOWN
        for _ in range(rounds if words else 0):
            expected, likely, chars = np.zeros_like(p), 0.0, 0.0
            log = np.log(np.maximum(p, 1e-300))
            for own in runs(words, CELLS, CELLS):
                texts, w = [words[i] for i in own], weight[own]
                got, total = occurrences(finder, texts, log, w)
                expected += got
                likely, chars = likely + float(total @ w), chars + float(w @ [len(t) for t in texts])
            p = (expected + 0.01) / (expected[1:-1].sum() + 0.01 * finder.count)
            p[0], p[-1] = 0, UNKNOWN
            level[k] = likely / max(chars, 1)
        table[:, k] = p
    return Model(languages, pieces, table, level)


def occurrences(finder: Pieces, words: list[str], log: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each piece is expected in weighted words, longest first, by forward and backward sums; log-probabilities."""
    size = np.array([len(w) for w in words])
    parts = [finder.hits(words[: int(np.searchsorted(-size, -start))], start) for start in range(0, int(size[0]), WINDOW)]
    h = Hits(*(np.concatenate([getattr(x, c) for x in parts]) for c in ("row", "end", "length", "ids")))
    begin, gain = h.end - h.length, log[h.ids]
    ahead, behind = np.zeros((int(size[0]) + 1, len(words))), np.full((int(size[0]) + 1, len(words)), -np.inf)
    places = np.arange(int(size[0]) + 2)
    bounds = np.searchsorted(h.end, places)
    for e in range(1, int(size[0]) + 1):
        a, b = bounds[e], bounds[e + 1]
        now = summed(ahead[begin[a:b], h.row[a:b]] + gain[a:b], h.row[a:b])
        ahead[e, : len(now)] = now
    rows = np.arange(len(words))
    total = ahead[size, rows]
    behind[size, rows] = 0
    order = np.argsort(begin * len(words) + h.row, kind="stable")
    row, end, own = h.row[order], h.end[order], gain[order]
    bounds = np.searchsorted(begin[order], places)
    for s in range(int(size[0]) - 1, -1, -1):
        a, b = bounds[s], bounds[s + 1]
        now = summed(behind[end[a:b], row[a:b]] + own[a:b], row[a:b])
        behind[s, : len(now)] = now
    chance = np.exp(ahead[begin, h.row] + gain + behind[h.end, h.row] - total[h.row]) * weight[h.row]
    return np.bincount(np.where(h.ids < 0, len(log) - 1, h.ids), chance, len(log)), total


def cut(values: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of lower-cased texts, marked; which of them each word is; offsets by text."""
    data, offsets = text_buffer(pc.utf8_lower(values.fill_null("")))
    part = _PART[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.r_[False, part[:-1]], np.r_[part[1:], False]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1
    if len(starts) == 0:
        return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gaps = np.empty(2 * len(starts) + 1, np.int32)
    gaps[0:-1:2], gaps[1::2], gaps[-1] = starts, ends, len(data)
    runs = pa.StringArray.from_buffers(len(gaps) - 1, pa.py_buffer(gaps), pa.py_buffer(np.ascontiguousarray(data)))
    distinct = runs.take(pa.array(np.arange(0, len(gaps) - 1, 2))).dictionary_encode()
    which = distinct.indices.to_numpy().astype(np.int64)
    words = [MARK + w for w in distinct.dictionary.to_numpy(zero_copy_only=False)]
    return words, which, np.searchsorted(starts, offsets)


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_fit")) -> DataFrame:
    """``docs`` with the columns ``names``: the predicted language; its posterior under equal priors; how far the text's
    log-probability a character in that language lies from that of the words it was learned from (about 0 for its own
    texts, far below for other languages and noise).

    From the whole text alone; null texts and texts without a letter are ``und`` with score 0 and a null fit, and so is
    everything if no language was learned. Columns pass through, save those of the three names, which are replaced. Memory
    is bounded by the slice of texts and by SUMS, whatever the number of languages; time grows with it."""
    kept = docs.drop(*names)
    small_batches(docs.sparkSession)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                values = part.column(part.schema.get_field_index("text"))
                letters = pc.match_substring_regex(values.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
                pred, sure, fit = [UNDETERMINED] * len(values), np.zeros(len(values)), [None] * len(values)
                words, which, offsets = cut(values)
                if words and model.languages:
                    log = model.log_words(words)
                    chars = np.array([len(w) for w in words], float)[which]
                    sums = np.zeros((len(values), len(model.languages)))
                    text = np.repeat(np.arange(len(values)), np.diff(offsets))
                    for k in range(len(model.languages)):
                        sums[:, k] = np.bincount(text, log[which, k], len(values))
                    best = sums.argmax(axis=1)
                    sure = np.where(letters, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0)
                    pred = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
                    each = sums[np.arange(len(values)), best] / np.maximum(np.bincount(text, chars, len(values)), 1) - model.level[best]
                    fit = [float(x) if ok else None for x, ok in zip(each, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(fit, pa.float64())], [*part.schema.names, *names])

    types = (T.StringType(), T.DoubleType(), T.DoubleType())
    return kept.mapInArrow(named, T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types, strict=True))]))


def learn(docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Model:
    """Learn from documents with a lang whose crc32(doc_id) mod 4 is not 2, about ``sample`` of each language: those whose
    hashed id and text fall below that share, up to ``SAMPLE_CHARS`` characters long. So repeated ids are drawn one by one
    and equal rows count as one another's words: what reaches the driver is bounded by sample and languages."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    shares = rows.groupBy("lang").agg((sample / F.count("*")).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id", "text"), 11) * F.lit(2.0**-53)
    few = [tuple(r) for r in shares.limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:  # as literals: no join at all
        named = rows.withColumn("share", F.create_map(*[F.lit(x) for r in sorted(few) for x in r])[F.col("lang")] if few else F.lit(0.0))
    else:
        named = rows.join(shares, "lang")
    chosen = named.where((place < F.col("share")) & (F.length("text") <= SAMPLE_CHARS))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, which, offsets = cut(part.column(1))
                langs, text = part.column(0).to_pylist(), np.repeat(np.arange(part.num_rows), np.diff(offsets))
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])
                if words:
                    pairs, n = np.unique(of[text] * len(words) + which, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[p // len(words)] for p in pairs]), pa.array([words[p % len(words)] for p in pairs]), pa.array(n)], ["lang", "word", "n"])

    table = chosen.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = {}
    for r in table:
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return train(vocabulary_pieces(vocabulary), counts)


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 4 is 2; null for a null doc_id), lang_pred, score."""
    rows = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
