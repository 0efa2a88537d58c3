"""Vectorised encoding with a word-level BPE vocabulary file.

Words of Latin letters are split by the file's own pattern and merged in arrays:
words of one length form a matrix, each round merges the pair of lowest rank in
every row, and each row thereby loses one column.  Any word with other
characters or a special token goes to the tokenizers library.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from tokenizers import Tokenizer

NONE = np.int32(2**31 - 1)
#: Bytes of a piece up to which it is merged here.
LONGEST = 48
#: Words whose ids are kept at most.
REMEMBERED = 600_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next
    one from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern + "|\n")
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = made  # by rank
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.keys)] = True
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> 12

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging each pair, NONE where there is no such merge."""
        keys = (a.astype(np.int64) << 16) | b
        out = np.full(len(keys), NONE, np.int32)
        at = np.flatnonzero(self.maybe[self._slot(keys)])
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        out[at[hit]] = self.rank[place[hit]]
        return out

    def merge(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges words of one length, a row of bytes each: (row numbers, ids) by final length."""
        ids = self.inner[rows]
        ids[:, -1] = self.last[rows[:, -1]]
        number, done = np.arange(len(rows)), []
        ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while ids.shape[1] > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ids)), at]
            ready = best == NONE
            if ready.any():
                done.append((number[ready], ids[ready]))
                go = ~ready
                ids, ranks, number, at, best = ids[go], ranks[go], number[go], at[go], best[go]
                if not len(ids):
                    return done
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = self.made[best]
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        done.append((number, ids))
        return done

    def _learn_pieces(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            if size > LONGEST:
                for i in own:
                    self.pieces[pieces[i]] = np.array(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids, np.uint32).tobytes()
                continue
            rows = np.frombuffer(b"".join([raw[i] for i in own]), np.uint8).reshape(len(own), size)
            for number, ids in self.merge(rows):
                data, width = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for j, i in enumerate(own[number]):
                    self.pieces[pieces[i]] = data[j * width : (j + 1) * width]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [max(t) < "ɐ" and not any(s in t for s in self.special) for t in texts]
        odd = [i for i, p in enumerate(plain) if not p]
        if odd:
            found = self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
            for i, e in zip(odd, found, strict=True):
                self.words[words[i]] = np.array(e.ids, np.uint32).tobytes()
        own = [i for i, p in enumerate(plain) if p]
        found = self.split.findall("\n".join([texts[i] for i in own]).lower())
        fresh = {p for p in found if p not in self.pieces}
        fresh.discard("\n")
        self._learn_pieces(list(fresh))
        held: list[bytes] = []
        at, get = 0, self.pieces.__getitem__
        for p in found:
            if p == "\n":
                self.words[words[own[at]]] = b"".join(held)
                held, at = [], at + 1
            else:
                held.append(get(p))
        if own:
            self.words[words[own[at]]] = b"".join(held)

    def encode_many(self, texts: list[bytes | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of whole texts, each with the id ``end`` after it if given.

        The vocabulary drops white space and no piece crosses it, so a text's ids
        are those of its runs without white space; each distinct run is encoded once."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        split = [x.split() if x else [] for x in texts]
        known = self.words
        missing = {w for x in split for w in x if w not in known}
        if missing:
            self._learn(list(missing))
        tail = [] if end is None else [np.array([end], np.uint32).tobytes()]
        return [np.frombuffer(b"".join([*map(known.__getitem__, x), *tail]), np.uint32) for x in split]


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One encoder for each file and worker, so that what it remembers lasts."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]
