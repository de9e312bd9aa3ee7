"""Exact tokenization of whole texts at the speed of a cache.

A tokenizer of the ``tokenizers`` library cuts a text into words before it merges; such a word never
runs from a non-space character on into white space, nor from a Latin letter on into an ASCII comma
or full stop. Cut at those places, a text falls into units whose ids, in a row, are the ids of the
whole text. Units repeat a lot, so each worker encodes a unit once and keeps its ids (bounded by
``CACHE_UNITS``). Arrow splits the texts and finds the distinct units; NumPy joins the ids.

Strings of added tokens, such as ``<|endoftext|>``, are tokens wherever a text holds them, as the library has
it by default: they are cut out first, and what stands between them is encoded as texts are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units a worker keeps; beyond that it starts anew.
CACHE_UNITS = 700_000
#: Unicode's White_Space without line feed and space, fixed values.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0  -     　"
#: Parts that show a text which the quick way of cutting doesn't fit.
_HARD = f"[{OTHER_SPACE}\x00\x01\x1c-\x1f]|[ \n][ \n]|^[ \n]|[ \n]$"
_UNIT = re.compile(f"[ \n{OTHER_SPACE}]*[^ \n{OTHER_SPACE}]+|[ \n{OTHER_SPACE}]+")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] for all i, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    """Ids of whole texts by a tokenizer file, the same as of the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.raw = Tokenizer.from_file(path)
        added = {t.content: (i, t.lstrip or t.rstrip or t.single_word or t.normalized) for i, t in self.raw.get_added_tokens_decoder().items()}
        self.added = {text: i for text, (i, _) in added.items()}
        self.plain = not any(odd for _, odd in added.values())  # those that are found by their strings alone
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")
        self._forget()
        line = self._ids("\n")
        alone = all(self._ids(f"a\n{u}") == [*self._ids("a"), *line, *self._ids(u)] for u in ("b", "B1", ",x", "'s", "%%"))
        self.line = np.array(line, np.uint32) if alone else None
        # a separator that is one token of its own between any two units, for encoding many in one call
        self.sep, self.sep_id = next(((s, i[0]) for s in ("\n", " \x01 ") if len(i := self._ids(s)) == 1 and self._ids(f" a{s} b{s},c{s}d") == [x for u in (" a", " b", ",c", "d") for x in [*self._ids(u), i[0]]][:-1]), (None, None))

    def _ids(self, text: str) -> list[int]:
        return self.raw.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # unit -> its number; its ids are flat[ends[number] : ends[number + 1]]
        self.flat, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _keep(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, held = len(self.known), int(self.ends[len(self.known)])
        while held + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[held : held + len(ids)] = ids
        self.ends[n + 1 : n + len(units) + 1] = held + np.cumsum(sizes)
        self.known.update(zip(units, range(n, n + len(units)), strict=True))

    def _learn(self, units: list[str]) -> None:
        for i in range(0, len(units), 2000):
            part = units[i : i + 2000]
            if self.sep is not None and not any("\n" in u or "\x01" in u or not u for u in part):
                ids = np.array(self.raw.encode_batch_fast([self.sep.join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                cuts = np.flatnonzero(ids == self.sep_id)
                if len(cuts) == len(part) - 1:
                    self._keep(part, np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                    continue
            each = [e.ids for e in self.raw.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.array([x for y in each for x in y], dtype=np.uint32), np.fromiter(map(len, each), np.int64, len(each)))

    def _lookup(self, units: list[str], keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each unit begin, and how many they are. ``units`` must be distinct."""
        if len(self.known) > CACHE_UNITS and not keep:
            self._forget()
        new = [u for u in units if u not in self.known]
        fed = [u for u in new if u[:1] == "\n" and self.line is not None and u[1:] and not u[1].isspace()]
        if fed:  # a line feed's ids, then the unit's own: no token runs across
            skip = set(fed)
            new = [u for u in new if u not in skip]
            own = dict.fromkeys(u[1:] for u in fed)
            new += [u for u in own if u not in self.known and u not in skip]
            new = list(dict.fromkeys(new))
        self._learn(new)
        if fed:
            at = np.fromiter((self.known[u[1:]] for u in fed), np.int64, len(fed))
            starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
            n = len(self.line)
            ids = np.empty(int(sizes.sum()) + n * len(fed), np.uint32)
            begins = np.cumsum(sizes + n) - sizes - n
            ids[_ragged(begins + n, sizes)] = self.flat[_ragged(starts, sizes)]
            for k, x in enumerate(self.line):
                ids[begins + k] = x
            self._keep(fed, ids, sizes + n)
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        return self.ends[at], self.ends[at + 1] - self.ends[at]

    def _distinct(self, keys: list[str], keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """As _lookup, for keys that may repeat; with ``keep`` nothing is forgotten meanwhile."""
        number: dict[str, int] = {}
        back = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
        starts, sizes = self._lookup(list(number), keep)
        return starts[back], sizes[back]

    def _by_units(self, text: str) -> np.ndarray:
        starts, sizes = self._distinct(_UNIT.findall(text))
        return self.flat[_ragged(starts, sizes)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32) and the number of ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        with_added = np.zeros(n, bool)
        for x in self.added:
            with_added |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        hard = with_added | pc.match_substring_regex(texts, _HARD).to_numpy(zero_copy_only=False)
        rows: list = [None] * n
        easy = np.flatnonzero(~hard)
        if len(easy):
            cut = pc.replace_substring(texts if len(easy) == n else texts.take(pa.array(easy)), "\n", " \n")
            cut = pc.replace_substring_regex(cut, f"([{_LATIN}])([,.])", "\\1 \x01\\2")
            lists = pc.split_pattern(cut, " ")
            coded = lists.values.dictionary_encode()
            names = coded.dictionary.to_pylist()
            # a unit as it stands in the text: behind a line feed, behind nothing (\x01), else behind a space
            keys = [u if (c := u[:1]) == "\n" else u[1:] if c == "\x01" else f" {u}" for u in names]
            starts, sizes = self._distinct(keys)
            at = coded.indices.to_numpy()
            begins, each = starts[at], sizes[at]
            heads = lists.offsets.to_numpy()[:-1]  # nothing stands before a text's first unit
            kinds, back = np.unique(at[heads], return_inverse=True)
            starts, sizes = self._distinct([names[k] for k in kinds], keep=True)
            begins[heads], each[heads] = starts[back], sizes[back]
            out = self.flat[_ragged(begins, each)]
            ends = np.concatenate([[0], np.cumsum(each)])[lists.offsets.to_numpy()]
            if len(easy) == n:
                return out, np.diff(ends)
            for k, i in enumerate(easy):
                rows[i] = out[ends[k] : ends[k + 1]]
        for i in np.flatnonzero(hard):
            text = texts[int(i)].as_py()
            if not with_added[i]:
                rows[i] = self._by_units(text)
            elif self.plain:
                parts = self.cut.split(text)  # every second one is an added token
                rows[i] = np.concatenate([np.array([self.added[x]], np.uint32) if k % 2 else self._by_units(x) for k, x in enumerate(parts)])
            else:
                rows[i] = np.array(self._ids(text), np.uint32)
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, n)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file, with its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
