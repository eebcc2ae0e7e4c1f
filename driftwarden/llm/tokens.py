"""Token ids of whole texts by a public tokenizer, each distinct piece of text encoded once.

The tokenizer's own pattern never joins a sign with white space that follows it, so a text falls into runs
of white space plus the word behind them that are encoded independently. Such runs repeat: they
are found and hashed as arrays, and only those a worker has not met yet go to the tokenizer; bytes are compared wherever a hash is met again. Texts with white space
outside ASCII or with the opening of a special token are encoded as one run, so ids are always those of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa

from driftwarden.llm.hashing import byte_runs, byte_slices, is_space, take_ranges

REMEMBERED_RUNS, RECENT_RUNS, LONGEST_REMEMBERED = 1 << 18, 1 << 15, 64
#: Runs that are compared at a time.
COMPARED_RUNS = 1 << 14


class Encoder:
    """Encodes columns of texts; remembers short runs, ``REMEMBERED_RUNS`` at most."""

    def __init__(self, path: str) -> None:
        self.path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.openings = {x["content"].encode()[:2] for x in made.get("added_tokens", ())}
        top = max(made["model"]["vocab"].values(), default=0) if isinstance(made["model"].get("vocab"), dict) else 1 << 16
        self.width = 2 if max([top, *(x["id"] for x in made.get("added_tokens", ()))]) < 1 << 16 else 4
        self.word = byte_pairs(made) or self._exactly
        self._forget()

    def _forget(self) -> None:
        self.old, self.recent = _Runs.none(), _Runs.none()
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.text, self.kept = np.zeros(1 << 16, np.uint8), 0

    def documents(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        """Ids of consecutive texts, each followed by id 0; ``first[i]:first[i + 1]`` are those of text i."""
        for data, offsets, rows in byte_slices(texts):
            starts, ends = self._runs(data, offsets)
            at, size, ids = self._encoded(data, starts, ends)
            first_run = np.searchsorted(starts, offsets)
            per_run = np.concatenate(([0], np.cumsum(size)))
            n = per_run[first_run[1:]] - per_run[first_run[:-1]] + 1
            first = np.concatenate(([0], np.cumsum(n)))
            out = np.zeros(first[-1], np.int32)
            text_of = np.repeat(np.arange(len(n)), np.diff(first_run))
            out[take_ranges(per_run[:-1] + text_of, size)] = ids[take_ranges(at, size)]
            yield out, first, rows

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = is_space(data)
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = blank[1:] & ~blank[:-1]
        for i in np.flatnonzero(self._whole(data, offsets)):
            begin[offsets[i] : offsets[i + 1]] = False
        filled = offsets[:-1][np.diff(offsets) > 0]
        begin[filled] = True
        starts = np.flatnonzero(begin[: len(data)])
        return starts, np.append(starts[1:], len(data))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that must not be cut into runs."""
        marks = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        for opening in self.openings:
            if len(opening) == 2:
                marks.append(np.flatnonzero((data[:-1] == opening[0]) & (data[1:] == opening[1])))
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        if len(lead):
            padded = np.append(data, [0, 0])
            a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
            blank = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            blank |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            blank |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            blank |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            blank |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
            marks.append(lead[blank])
        found = np.zeros(len(offsets) - 1, bool)
        found[np.searchsorted(offsets, np.concatenate(marks), "right") - 1] = True
        return found

    def _exactly(self, text: str) -> list[int]:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run the place and number of its ids, and the ids."""
        hashed = byte_runs(data, starts, ends)
        keys, sample, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.old.keys) > REMEMBERED_RUNS:
            self._forget()
        first, length = starts[sample], (ends - starts)[sample]
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for table in (self.old, self.recent):
            place, row = table.find(keys)
            alike = table.length[place] == length[row]
            place, row = place[alike], row[alike]
            good = same_bytes(self.text, table.text[place], data, first[row], length[row])
            at[row[good]], size[row[good]] = table.at[place[good]], table.size[place[good]]
        new = np.flatnonzero(at < 0)
        new = new[np.argsort(length[new] > LONGEST_REMEMBERED, kind="stable")]
        at[new], size[new] = self._coded(data, first[new], length[new])
        short = new[: int((length[new] <= LONGEST_REMEMBERED).sum())]
        self._remember(data, keys[short], at[short], size[short], first[short], length[short])
        at, size, used = at[inverse], size[inverse], self.used
        # runs with the hash of another run of the slice are told apart by their bytes
        copies = np.flatnonzero(sample[inverse] != np.arange(len(starts)))
        of = sample[inverse[copies]]
        alike = (ends - starts)[copies] == (ends - starts)[of]
        alike[alike] = same_bytes(data, starts[copies[alike]], data, starts[of[alike]], (ends - starts)[of[alike]])
        odd = copies[~alike]
        if len(odd):
            self.used = int(max(used, (at + size).max()))
            at[odd], size[odd] = self._coded(data, starts[odd], (ends - starts)[odd])
            self.used = used
        return at, size, self.ids

    def _coded(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode runs behind the ids in use: place and number of their ids."""
        fresh = [bytes(data[s : s + n]).decode() for s, n in zip(first, length, strict=True)]
        coded = [self._exactly(x) if "<|" in x else self.word(x) for x in fresh]
        size = np.array([len(x) for x in coded], np.int32)
        at = self.used + np.cumsum(size, dtype=np.int64) - size
        end = self.used + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end - len(self.ids), len(self.ids)), np.int32)])
        self.ids[self.used : end] = np.fromiter(chain.from_iterable(coded), np.int32, end - self.used)
        return at, size

    def _remember(
        self, data: np.ndarray, keys: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray, length: np.ndarray
    ) -> None:
        end = self.kept + int(length.sum())
        if end > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(max(end - len(self.text), len(self.text)), np.uint8)])
        self.text[self.kept : end] = data[take_ranges(first, length)]
        text = self.kept + np.cumsum(length) - length
        self.recent = self.recent.joined(_Runs(keys, at, size, text, length.astype(np.int32)))
        self.used, self.kept = self.used + int(size.sum()), end
        if len(self.recent.keys) > RECENT_RUNS:
            self.old, self.recent = self.old.joined(self.recent), _Runs.none()


def same_bytes(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``a[first:first + length]`` equals the same stretch of ``b``, for every pair; some runs at a time, to keep memory small."""
    same = np.ones(len(length), bool)
    for i in range(0, len(length), COMPARED_RUNS):
        some = slice(i, i + COMPARED_RUNS)
        differs = np.flatnonzero(a[take_ranges(a_first[some], length[some])] != b[take_ranges(b_first[some], length[some])])
        if len(differs):
            same[i + np.unique(np.searchsorted(np.cumsum(length[some]), differs, "right"))] = False
    return same


@dataclass
class _Runs:
    """Known runs sorted by hash: place and number of their ids, place and length of their bytes."""

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray
    text: np.ndarray
    length: np.ndarray

    @staticmethod
    def none() -> _Runs:
        return _Runs(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def place(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are known, and which those are."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = self.place(keys)
        row = np.flatnonzero(self.keys[place] == keys)
        return place[row], row

    def joined(self, other: _Runs) -> _Runs:
        order = np.argsort(np.concatenate([self.keys, other.keys]), kind="stable")
        columns = ("keys", "at", "size", "text", "length")
        return _Runs(*(np.concatenate([getattr(self, c), getattr(other, c)])[order] for c in columns))


def byte_pairs(made: dict) -> Callable[[str], list[int]] | None:
    """The encoder of a vocabulary file on a faster library, for texts without special tokens; nothing if the file is of another kind.

    That library merges the pair of least id first, which is the file's order only if ids count the merges.
    """
    import public_tokenizers
    import tiktoken

    model, before = made["model"], made.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or made.get("normalizer"):
        return None
    if model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"):
        return None
    vocabulary = model["vocab"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if [vocabulary["".join(x)] for x in pairs] != list(range(256, 256 + len(pairs))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"] for x in made.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if word not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
