"""Whole-text BPE encoding with the tokenizers library, one library call per distinct word.

A pre-token never crosses from a non-space to a following ASCII white-space byte, for either supported splitting
pattern. So a text's ids are those of its chunks in order, a chunk being a run of white space with the run of other
characters after it. Chunks are found in numpy and made distinct in Arrow; only chunks that this Python worker has not
met yet go to the library. Texts with white space outside ASCII are encoded whole, as there the rule does not hold.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from clausegraph.llm.common import kept_between_tasks, let_go, text_buffer

#: Chunks remembered by a worker before it starts anew; bounds its memory.
CACHE_CHUNKS = 600_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _visible_bytes() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE, by its rule: printable Latin-1 stays, others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes string arrays with the tokenizer file at ``path``; special strings in a text are ordinary text."""

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        split = next((s for s in steps if s and s["type"] == "Split"), None)
        self.lower = bool(spec["normalizer"])
        # Words that are one pre-token each; every other chunk goes through the library's own normaliser and splitter.
        self.simple = r"^[\t-\r ]*[a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$" if split else r"^ ?\pL+$"
        self.visible = _visible_bytes() | {10: "\n"}
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.store = [np.zeros(0, self.dtype)]
        self.counts = [np.zeros(0, np.int64)]

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and int64 offsets by text; nulls are empty texts."""
        odd = pc.match_substring_regex(values.fill_null(""), _OTHER_SPACE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode(values)
        ids, offsets = self._encode(pc.if_else(pa.array(odd), pa.scalar("", values.type), values))
        parts = np.split(ids, offsets[1:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.full.encode(values[int(i)].as_py(), add_special_tokens=False).ids, self.dtype)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)

    def _encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffer(values)
        if len(data) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        space = _SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        bounds = np.r_[starts, len(data)].astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        distinct = chunks.dictionary_encode()
        which = self._rows(distinct.dictionary)[distinct.indices.to_numpy()]
        store, begin, count = self.flat
        sizes = count[which]
        ends = np.cumsum(sizes)
        where = np.repeat((begin[which] - (ends - sizes)).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        ids = store[where]
        by_text = np.searchsorted(starts, offsets)
        return ids, np.r_[0, ends][by_text]

    def _rows(self, chunks: pa.StringArray) -> np.ndarray:
        """Where each chunk's ids stand in the store, meeting new chunks on the way."""
        if len(self.seen) > CACHE_CHUNKS:
            self.clear()
        names, get = chunks.to_numpy(zero_copy_only=False), self.seen.get
        rows = np.array([get(c, -1) for c in names], np.int64)
        if len(new := np.flatnonzero(rows < 0)):
            self._learn(chunks.take(pa.array(new)))
            self.store, self.counts = [np.concatenate(self.store)], [np.concatenate(self.counts)]
            count = self.counts[0]
            self.flat = self.store[0], np.cumsum(count) - count, count
            rows[new] = [self.seen[c] for c in names[new]]
        return rows

    def _learn(self, new: pa.StringArray) -> None:
        plain = pc.match_substring_regex(new, self.simple)
        words, odd = new.filter(plain), new.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        texts = pc.utf8_lower(pc.ascii_trim_whitespace(words)) if self.lower else words
        words, texts = words.to_numpy(zero_copy_only=False), texts.to_numpy(zero_copy_only=False)
        for k in range(0, len(words), 128):
            line = "\n".join(texts[k : k + 128]).encode().decode("latin-1").translate(self.visible)
            got = self.words.encode(line, add_special_tokens=False)
            self._add(words[k : k + 128], np.array(got.ids, self.dtype), np.bincount(got.word_ids, minlength=len(words[k : k + 128])))
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            got = [e.ids for e in self.full.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.array([i for ids in got for i in ids], self.dtype), np.array([len(ids) for ids in got], np.int64))

    def _add(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.seen)
        self.seen.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.store.append(ids)
        self.counts.append(counts)


_encoders: dict[str, Encoder] = {}
_drop = _encoders.clear
kept_between_tasks.append(_drop)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; Spark reuses its Python workers, so what it has met is kept between tasks."""
    let_go(keep=_drop)
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
