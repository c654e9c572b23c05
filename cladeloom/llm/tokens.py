"""Whole texts to token ids with a public vocabulary file, each distinct part of a word encoded once per worker.

In this kind of vocabulary (checked when the file is loaded) white space always ends a token, a token
never spans a letter or digit and the punctuation after it, and A-Z are lowered first. So a text's ids are
the ids of its parts, one after the other; a part is a word's core or the punctuation at its end. Parts are
known by a 64-bit hash and their length; up to `MEMORY_PARTS` are remembered, then the memory starts anew,
so it never grows with the corpus.
"""
from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from cladeloom.llm.text import LOWER_VALUES, U64, ranges, word_hash, word_spans

MEMORY_PARTS = 1_000_000
#: Words end at these bytes; any other white space stays within a "word" and is left to the tokenizer.
BLANK = np.isin(np.arange(256), np.frombuffer(b" \n\t", np.uint8))
#: ASCII punctuation, and letters and digits of ASCII.
MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Parts encoded together in one call, and the control character between them.
CALL_PARTS = 256
FENCE = "\x01"


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "Split"]
        lowers = any(n["type"] == "Lowercase" for n in spec["normalizer"].get("normalizers", [spec["normalizer"]]))
        odd = any(t["lstrip"] or t["rstrip"] or " " in t["content"] or not t["content"].startswith("<|") for t in spec["added_tokens"])
        if odd or not lowers or not any(p["behavior"] == "Removed" and p["invert"] for p in splits):
            raise ValueError(f"{path}: this vocabulary keeps case or white space")
        self.tokenizer = Tokenizer.from_file(path)
        [self.fence] = self.tokenizer.encode(FENCE, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.keys, self.number = np.zeros(0, U64), np.zeros(0, np.int64)  # sorted hashes, and which part each is
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at = np.zeros(1, np.int64)  # ids of part i: flat[at[i]:at[i + 1]]

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encodes new parts (keys sorted), many to a call, with a fence between them."""
        alone = [i for i, t in enumerate(texts) if FENCE in t]
        shared = [i for i, t in enumerate(texts) if FENCE not in t]
        calls = [shared[i:i + CALL_PARTS] for i in range(0, len(shared), CALL_PARTS)] + [[i] for i in alone]
        sizes, parts, order = [], [], []
        for call, e in zip(calls, self.tokenizer.encode_batch_fast([f" {FENCE} ".join(texts[i] for i in c) for c in calls], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            order += call
            if len(call) == 1:
                sizes.append(np.array([len(ids)]))
                parts.append(ids)
                continue
            fence = ids == self.fence
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(fence), [len(ids)]])) - 1)
            parts.append(ids[~fence])
            if len(sizes[-1]) != len(call):
                raise AssertionError("fences were not found")
        new = np.concatenate(parts)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(new)), np.uint32)])
        self.flat[self.used:self.used + len(new)] = new
        n = len(self.at) - 1
        self.at = np.concatenate([self.at, self.used + np.cumsum(np.concatenate(sizes))])
        self.used += len(new)
        number = np.empty(len(keys), np.int64)
        number[order] = n + np.arange(len(keys))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, where, keys), np.insert(self.number, where, number)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands among the known ones, -1 where it is new."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the offsets of each text (rows + 1); `end` is
        appended to every text."""
        starts, ends, first = word_spans(buf, offsets, BLANK)
        if len(starts):
            begin, stop, count, keys = cut(buf, starts, ends)
            distinct, at, of = np.unique(keys, return_index=True, return_inverse=True)
            found = self.find(distinct)
            if (found < 0).any():
                if len(self.keys) + int((found < 0).sum()) > MEMORY_PARTS and len(self.keys):
                    self.forget()
                    found = self.find(distinct)
                raw, new = buf.tobytes(), np.flatnonzero(found < 0)
                self.learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[at[new]].tolist(), stop[at[new]].tolist())])
                found = self.find(distinct)
            part = self.number[found][of]
            size = self.at[part + 1] - self.at[part]
            ids = self.flat[np.repeat(self.at[part], size) + ranges(size)]
            offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])[first]]
        else:
            ids, offsets = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if end is not None:
            ids = np.insert(ids, offsets[1:], np.uint32(end))
            offsets = offsets + np.arange(len(offsets))
        return ids, offsets


def cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the parts of all words, and the number of parts (1 or 2) of each word. A word whose core
    does not surely end with a letter or digit, or that holds the beginning of a special token, stays whole."""
    position = np.arange(len(buf))
    core = np.maximum.accumulate(np.where(MARK[buf], -1, position))[ends - 1] + 1  # after the last byte that is no mark
    inside = (core > starts) & (core < ends)
    last, before = buf[core - 1], buf[np.maximum(core - 2, 0)]
    letter = ALNUM[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (core - 2 >= starts)  # ASCII or Latin-1
    special = np.zeros(len(starts), bool)
    special[np.searchsorted(starts, np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))), "right") - 1] = True
    two = inside & letter & ~special
    count = 1 + two
    word = np.repeat(np.arange(len(starts)), count)
    second = ranges(count) == 1
    begin = np.where(second, core[word], starts[word])
    stop = np.where(second | ~two[word], ends[word], core[word])
    keys = word_hash(buf, begin, stop, LOWER_VALUES) + (stop - begin).astype(U64) * U64(0x9E3779B97F4A7C15)
    if special.any():  # case matters in special tokens
        of = special[word]
        keys[of] = word_hash(buf, begin[of], stop[of]) * U64(0xD6E8FEB86659FD93) + U64(1)
    return begin, stop, count, keys


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
