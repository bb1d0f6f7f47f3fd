"""Whole-text encoding with a public tokenizer, by distinct pieces.

A byte-level BPE whose pre-tokenizer splits by the usual pattern and that has no normaliser never merges across the
edge between a run of non-space and the white space after it, so a text's ids are the ids of its pieces (white space
and the word after it) in turn. That the tokenizer is of this kind is read from its own settings when it is loaded
(``by_pieces``); texts of any other are encoded whole. Each worker encodes a distinct piece once with the
tokenizers library and keeps its bytes and ids; bytes are compared at every use. A text that holds a
special token's string or white space beyond 0x20 and 0x09-0x0D is encoded whole by the library.
"""

from __future__ import annotations

import json
import re

import numpy as np

from tessera.llm.shared import kept
from tessera.llm.textops import SPACE, span_hashes

#: The name under which workers keep their encoders.
KEPT = "encoders"

#: Pieces a worker keeps; beyond them it forgets all and starts again.
CACHE_PIECES = 1_500_000
#: Pieces whose bytes are compared at once.
SAME_PIECES = 20_000

_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_workers: dict[str, "Encoder"] = kept(KEPT)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def splits_at_space(settings: dict) -> bool:
    """Whether the settings say a byte-level BPE with the usual pattern, with nothing that looks or acts beyond a piece."""
    model, pre = settings["model"], settings.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    exact = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in settings.get("added_tokens", []))
    return bool(plain and level and exact and not settings.get("normalizer") and not settings.get("truncation") and not settings.get("padding"))


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sizes = None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_pieces = splits_at_space(json.loads(self.tokenizer.to_str()))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted piece hashes
        self.at = np.zeros(0, np.int64)  # where a slot's bytes begin, and how many they are
        self.size = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """(begin, end) in characters of every token of each text, encoded whole.

        The tokens of a byte-level vocabulary (read from the settings) tile a text's bytes, one character of the
        vocabulary a byte, so its spans follow from the ids; for any other they are the library's offsets.
        """
        if self.by_pieces:
            if self.sizes is None:
                vocab = self.tokenizer.get_vocab(with_added_tokens=True)
                self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
                self.sizes[list(vocab.values())] = [len(token) for token in vocab]
            out = []
            for text, ids in zip(texts, self._library(texts), strict=True):
                ends = np.cumsum(self.sizes[np.array(ids, np.int64)])
                if len(ids) and not text.isascii():  # the character that each byte is of
                    raw = np.frombuffer(text.encode(), np.uint8)
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1
                    begins = np.concatenate(([0], ends[:-1]))
                    out.append(np.stack((char[begins], char[ends - 1] + 1), axis=1))
                else:
                    out.append(np.stack((ends - self.sizes[np.array(ids, np.int64)], ends), axis=1))
            return out
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.offsets, np.int64).reshape(-1, 2) for e in got]

    def odd(self, text: str) -> bool:
        return bool(_ODD.search(text)) or any(s in text for s in self.special)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.forget()
        got = self._library([p.decode("utf-8", "replace") for p in pieces])
        size = np.array([len(p) for p in pieces], np.int64)
        self.at = np.append(self.at, len(self.text) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.text = np.append(self.text, np.frombuffer(b"".join(pieces), np.uint8))
        n = np.array([len(i) for i in got], np.int64)
        slot = np.arange(len(keys)) + len(self.first) - 1
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n))
        self.ids = np.append(self.ids, np.array([x for i in got for x in i], np.uint32))
        here = np.searchsorted(self.keys, keys)  # new keys come sorted
        self.keys, self.slot = np.insert(self.keys, here, keys), np.insert(self.slot, here, slot)

    def _same(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> bool:
        size = ends - starts
        if (self.size[slot] != size).any():
            return False
        for a in range(0, len(slot), SAME_PIECES):
            b = min(a + SAME_PIECES, len(slot))
            shift = np.repeat(self.at[slot[a:b]] - starts[a:b], size[a:b])
            if (self.text[np.arange(starts[a], ends[b - 1]) + shift] != buf[starts[a] : ends[b - 1]]).any():
                return False
        return True

    def _slots(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == want if len(self.keys) else np.zeros(len(want), bool)
        return at, known

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and the bounds of each document's."""
        if not self.by_pieces:
            return self._whole(buf.tobytes(), off)
        n_docs, n = len(off) - 1, len(buf)
        space = SPACE[buf]
        begin = np.zeros(n, bool)  # a piece begins at white space after ink, or where a document begins
        begin[1:] = space[1:] & ~space[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n) if len(starts) else starts
        piece_of = np.searchsorted(starts, off)
        keys = span_hashes(buf, starts, ends)
        fresh, where = np.unique(keys, return_index=True)
        if len(self.keys) + len(fresh) > CACHE_PIECES:
            self.forget()
        _, known = self._slots(fresh)
        fresh, where = fresh[~known], where[~known]
        raw = buf.tobytes()
        for a in range(0, len(fresh), 100_000):
            part = slice(a, a + 100_000)
            self._learn(fresh[part], [raw[starts[i] : ends[i]] for i in where[part]])
        at, known = self._slots(keys)
        if not known.all():  # more distinct pieces in one chunk than the cache holds
            return self._whole(raw, off)
        slot = self.slot[at]
        if not self._same(buf, starts, ends, slot):  # two pieces with one hash
            return self._whole(raw, off)
        count = self.first[slot + 1] - self.first[slot]
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = np.repeat(self.first[slot] - upto[:-1], count) + np.arange(upto[-1])
        ids, bounds = self.ids[flat], upto[piece_of]
        if self.odd(raw.decode("utf-8", "replace")):
            parts = np.split(ids, bounds[1:-1])
            for d in range(n_docs):
                text = raw[off[d] : off[d + 1]].decode("utf-8", "replace")
                if self.odd(text):
                    parts[d] = np.array(self._library([text])[0], np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds

    def _whole(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self._library([raw[off[d] : off[d + 1]].decode("utf-8", "replace") for d in range(len(off) - 1)])
        return np.array([x for i in got for x in i], np.uint32), np.concatenate(([0], np.cumsum([len(i) for i in got])))
