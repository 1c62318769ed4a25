"""Variable-length runs of ids in flat integer arrays."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa


def taken(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` one after the other and their lengths; run k is ``ids[ends[k] : ends[k + 1]]``."""
    starts, lengths = ends[at], ends[at + 1] - ends[at]
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, ids.dtype), lengths
    return ids[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)], lengths


class PieceTable:
    """Ids of pieces of text that come again and again. The table starts anew once it holds ``max_pieces`` or ``max_ids``; results do
    not depend on what it holds.

    ``encode``: ids of each of a list of new pieces.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], max_pieces: int, max_ids: int):
        self.encode, self.max_pieces, self.max_ids = encode, max_pieces, max_ids
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ends = array("q", [0])
        self.ids = array("i")

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after the other, and each piece's number of ids."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) >= self.max_pieces or len(self.ids) >= self.max_ids:
            self.clear()
        slots = list(map(self.slot.get, different))
        absent = [k for k, s in enumerate(slots) if s is None]
        if absent:
            new = [different[k] for k in absent]
            runs = self.encode(new)
            names = range(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip(new, names, strict=True))
            self.ends.frombytes((np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))) + len(self.ids)).tobytes())
            self.ids.extend(chain.from_iterable(runs))
            for k, name in zip(absent, names, strict=True):
                slots[k] = name
        at = np.array(slots, np.int64)[coded.indices.to_numpy()]
        ids = np.frombuffer(self.ids, np.int32) if len(self.ids) else np.zeros(0, np.int32)
        return taken(ids, np.frombuffer(self.ends, np.int64), at)  # the views go, so that the arrays can grow again
