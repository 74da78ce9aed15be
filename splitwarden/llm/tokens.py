"""Token ids of whole texts by a public tokenizer of the ``tokenizers`` library.

The byte-level pattern never joins a blank that is followed by a visible character to what
stands before it, so texts are cut there, every different piece of a slice is encoded once by
the library, and the ids are put together again. The result is the library's own (tested
against ``encode`` on whole texts); the cost follows the number of different pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from splitwarden.llm.text import as_bytes, range_hash

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
_JOINED = 400  # pieces encoded in one string
_MEMO_PIECES = 1_000_000  # remembered pieces of one task; beyond, the memory starts afresh

# A blank followed by one of these is not cut: white space, or a first byte of wide white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[:33] = True
_NO_CUT[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def encoder(name: str = TOKENIZER) -> Encoder:
    """The encoder of this process: tasks that follow in the same worker go on with its memory."""
    return Encoder(name)


class Encoder:
    """Encodes Arrow text columns and remembers the ids of pieces by two independent 64-bit hashes."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        # The library takes these strings out of a text before it cuts it into pieces.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Each character of a byte-level token stands for one byte.
        vocabulary = self.library.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes], first: np.ndarray, second: np.ndarray) -> None:
        """Encode pieces that are not remembered; most of them joined, as they split again."""
        blank = np.array([p[:1] == b" " and len(p) > 1 and not _NO_CUT[p[1]] for p in pieces], bool)
        order = np.concatenate((np.flatnonzero(~blank), np.flatnonzero(blank)))
        alone = [pieces[k] for k in order[: np.count_nonzero(~blank)]]
        joined = [pieces[k] for k in order[len(alone) :]]
        groups = [b"".join(joined[k : k + _JOINED]) for k in range(0, len(joined), _JOINED)]
        encoded = self.library.encode_batch_fast(
            [t.decode() for t in alone + groups], add_special_tokens=False
        )
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        done = np.cumsum(self.token_bytes[ids])
        stop = np.searchsorted(done, np.cumsum([len(pieces[k]) for k in order])) + 1
        size = np.diff(np.concatenate(([0], stop)))
        self.place = np.concatenate((self.place, len(self.store) + stop - size))
        self.size = np.concatenate((self.size, size))
        self.store = np.concatenate((self.store, ids))
        keys = np.concatenate((self.first, first[order]))
        sort = np.argsort(keys, kind="stable")
        self.second = np.concatenate((self.second, second[order]))[sort]
        self.first, self.place, self.size = keys[sort], self.place[sort], self.size[sort]

    def _find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, whether it is the same piece) of different pieces."""
        if not len(self.first):
            return np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        slot = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return slot, (self.first[slot] == first) & (self.second[slot] == second)

    def _plain(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Every row by the library as a whole: rows with an added token, slices in which two
        pieces share a hash."""
        for text in column.to_pylist():
            ids = self.library.encode(text or "", add_special_tokens=False).ids
            yield np.array([*ids, END_ID], np.uint32)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row, with ``END_ID`` at the end."""
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(np.diff(whole, prepend=~whole[:1], append=~whole[-1:]))
        for low, high in zip(turns[:-1].tolist(), turns[1:].tolist()):
            rows = column.slice(low, high - low)
            yield from self._plain(rows) if whole[low] else self._pieces(rows)

    def _pieces(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = as_bytes(column)
        if not len(data):
            for _ in range(len(column)):
                yield np.array([END_ID], np.uint32)
            return
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 32) & ~_NO_CUT[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        first, second = range_hash(data, start, end, 1), range_hash(data, start, end, 2)
        _, representative, group = np.unique(first, return_index=True, return_inverse=True)
        if not np.array_equal(second, second[representative][group]):
            yield from self._plain(column)
            return
        keys, more = first[representative], second[representative]
        slot, known = self._find(keys, more)
        if not known.all():
            if len(self.first) + np.count_nonzero(~known) > _MEMO_PIECES:
                self._forget()
                known = np.zeros(len(keys), bool)
            raw, new = data.tobytes(), np.flatnonzero(~known)
            ranges = zip(start[representative[new]].tolist(), end[representative[new]].tolist())
            self._learn([raw[s:e] for s, e in ranges], keys[new], more[new])
            slot, known = self._find(keys, more)
            if not known.all():
                yield from self._plain(column)
                return
        place, sizes, flat = self.place[slot], self.size[slot], self.store
        counts = sizes[group]
        stop = np.cumsum(counts)
        ids = flat[np.arange(stop[-1]) + np.repeat(place[group] - (stop - counts), counts)]
        before = np.concatenate(([0], stop))[np.searchsorted(start, offsets)]
        for low, high in zip(before[:-1].tolist(), before[1:].tolist()):
            yield np.append(ids[low:high], np.uint32(END_ID))
