"""Token ids of texts. A byte-level tokenizer cuts before it merges, so ids are remembered per word.

A unit is a word with the white space before it, or the marks after a word. A cut is made only where white space
follows a character that certainly is none, or a mark follows a letter: the tokenizer cuts there too, so it gives
the units of a text, one by one, the same ids as the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shipflow.llm import text as T

MOST_REMEMBERED = 1_500_000  # units per Python worker, some 60 MB; beyond it the memory starts anew
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[[ord(mark) for mark in ".,;:!?"]] = True
JOINED = 512  # unknown units given to the tokenizer as one text


class Tokens:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)  # sorted hashes of units
        self._place = np.zeros(0, np.int64)  # of each unit's ids in _ids
        self._count = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def ids(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, place of each row's ids, ids) for some rows at a time, without special tokens added."""
        bounds, data = T.text_bytes(column)
        for first, last in T.slices(bounds):
            starts, part = bounds[first : last + 1] - bounds[first], data[bounds[first] : bounds[last]]
            unit_starts = _unit_starts(part, starts)
            ends = np.append(unit_starts[1:], len(part))
            found = self._look_up(part, unit_starts, ends)
            counts = self._count[found]
            places = np.concatenate(([0], np.cumsum(counts)))
            take = np.repeat(self._place[found] - places[:-1], counts) + np.arange(places[-1])
            yield first, places[np.searchsorted(unit_starts, starts)], self._ids[take]

    def _look_up(self, data, starts, ends) -> np.ndarray:
        hashes = T.run_hashes(data, starts, ends)
        unknown, at = np.unique(hashes, return_index=True)
        if len(self._known):
            near = np.minimum(np.searchsorted(self._known, unknown), len(self._known) - 1)
            fresh = self._known[near] != unknown
            unknown, at = unknown[fresh], at[fresh]
        if len(unknown):
            if len(self._known) + len(unknown) > MOST_REMEMBERED and len(self._known):
                self._forget()
                return self._look_up(data, starts, ends)
            units = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in at]
            self._learn(unknown, units)
        return np.searchsorted(self._known, hashes)

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        ids, places, counts = self._encode(units)
        order = np.searchsorted(self._known, hashes)
        self._known = np.insert(self._known, order, hashes)
        self._place = np.insert(self._place, order, places + len(self._ids))
        self._count = np.insert(self._count, order, counts)
        self._ids = np.concatenate((self._ids, ids))

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and for each unit its place among them and its number of ids.

        Units of white space and a word can stand in one text; the tokenizer's offsets tell them apart.
        """
        spaces = " \t\n\v\f\r"
        joinable = [i for i, unit in enumerate(units) if unit[0] in spaces and unit[-1] not in spaces]
        alone = sorted(set(range(len(units))).difference(joinable))
        groups = [joinable[i : i + JOINED] for i in range(0, len(joinable), JOINED)]
        texts = ["".join([units[i] for i in group]) for group in groups] + [units[i] for i in alone]
        found = self._tokenizer.encode_batch(texts, add_special_tokens=False)
        counts, ids = [], []
        for group, text in zip(groups, found):
            begins = np.cumsum([0] + [len(units[i]) for i in group[:-1]])
            token_starts = np.array([start for start, _ in text.offsets])
            counts.append(np.diff(np.append(np.searchsorted(token_starts, begins), len(token_starts))))
            ids += text.ids
        for text in found[len(groups) :]:
            counts.append([len(text.ids)])
            ids += text.ids
        in_order = np.concatenate(counts).astype(np.int64)
        units_in_order = np.array(joinable + alone)
        count, place = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        count[units_in_order] = in_order
        place[units_in_order] = np.concatenate(([0], np.cumsum(in_order)[:-1]))
        return np.array(ids, np.uint32), place, count


def _unit_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places where units begin: at each text, at white space after what is none, at a mark after a letter."""
    space = T.IS_SPACE[data]
    plain = (data > 0x20) & (data < 0x7F)
    plain[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xCF)  # letters of two bytes: no white space among them
    letter = IS_LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins = np.zeros(len(data), bool)
    begins[1:] = (space[1:] & plain[:-1]) | (IS_MARK[data[1:]] & letter[:-1])
    begins[text_starts[:-1][text_starts[:-1] < len(data)]] = True
    return np.flatnonzero(begins)
