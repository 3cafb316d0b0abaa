"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task walks its own documents. The whole windows of a document become sequences at once; the rest of it is placed
online: an array counts, for each of 32 fill levels, the windows that are open at it, and the rest goes to the level that
leaves the least sum of squared counts. With that few levels the rule has few windows open, also after few documents. Those that stay open when the task
ends are refilled from one another, cutting pieces where needed (so too if they should be more than `most_open`, which bounds memory); a task's last,
shorter window is cut at powers of two, which need no padding. No rows move between tasks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .session import batches
from .words import as_strings, ragged, release, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SEPARATOR = "<|endoftext|>"


class WordTokens:
    """Token ids of texts, by the tokenizer, memoised for parts between which it never merges.

    The tokenizer drops white space and ends a token where an ASCII letter meets ASCII punctuation other than an
    apostrophe, and it ignores case. So ids of texts are the ids of such parts one after another. Texts that hold the
    text of a special token go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 2000):
            some = parts[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([_SEPARATOR.join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cut = np.concatenate([[-1], np.flatnonzero(ids == self.separator), [len(ids)]])
            n, at = len(some), len(self.index)
            while at + n > len(self.starts):
                self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[at : at + n] = self.used + cut[:-1] + 1
            self.lengths[at : at + n] = np.diff(cut) - 1
            self.used += len(ids)
            self.index.update(zip(some, range(at, at + n)))

    def _parts(self, parts: pa.Array) -> np.ndarray:
        names = parts.to_pylist()
        if len(self.index) + len(names) > self.most:
            self.forget()
        self._add([x for x in names if x not in self.index])
        return np.fromiter(map(self.index.__getitem__, names), dtype=np.int64, count=len(names))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        special = np.flatnonzero(pc.match_substring_regex(texts, r"(?i)<\|(startoftext|endoftext)\|>").to_numpy(zero_copy_only=False))
        whole = {int(k): np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, dtype=np.uint32) for k in special}
        if whole:
            texts = pa.array(["" if k in whole else t for k, t in enumerate(texts.to_pylist())], pa.string())
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        low = pc.replace_substring_regex(pc.ascii_lower(words.dictionary), r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        low = pc.ascii_split_whitespace(pc.replace_substring_regex(low, r"([!-&(-/:-@\[-`{-~])([a-z])", r"\1 \2"))
        parts = low.flatten().dictionary_encode()
        part = self._parts(parts.dictionary)[parts.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.lengths[part])])
        by_word = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(low).to_numpy(zero_copy_only=False))])]
        ids = ragged(self.flat, self.starts[part], self.lengths[part])
        word = words.indices.to_numpy()
        starts, lengths = by_word[:-1], np.diff(by_word)
        for low_row, high_row in _runs(first, 1 << 18):
            own = word[first[low_row] : first[high_row]]
            n = lengths[own]
            flat = ragged(ids, starts[own], n)
            cut = np.concatenate([[0], np.cumsum(n)])[first[low_row : high_row + 1] - first[low_row]]
            for row in range(low_row, high_row):
                yield whole[row] if row in whole else flat[cut[row - low_row] : cut[row - low_row + 1]]


def _runs(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    row, rows = 0, len(first) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(first, first[row] + most, side="right")) - 1)
        yield row, min(end, rows)
        row = end


class SumOfSquares:
    """Open windows by fill level. A piece is (doc_id, start, ids, doc_tokens); full windows and refilled ones come out of take().

    A level is `step` tokens wide. A window with less room than that counts as full: the next piece gives its first tokens to
    close it, and what is left of the piece is placed by the rule.
    """

    def __init__(self, window: int, most_open: int, base: int, levels: int = 32):
        self.window, self.step, self.most_open, self.next = window, max(1, window // levels), most_open, base
        self.open: list[list[tuple[int, list[tuple]]]] = [[] for _ in range(-(-window // self.step))]  # the lengths are the level array
        self.nearly: tuple[int, list[tuple]] | None = None
        self.n_open = self.refilled = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Cut off the whole windows; place the rest, if any."""
        total, whole = len(ids), len(ids) // self.window * self.window
        for k in range(0, whole, self.window):
            self._close([(doc_id, k, ids[k : k + self.window], total)])
        if whole < total:
            self._place((doc_id, whole, ids[whole:].copy(), total))

    def _put(self, fill: int, pieces: list[tuple], piece: tuple) -> None:
        """Add the piece to a window that has room for it."""
        pieces.append(piece)
        fill += len(piece[2])
        if fill == self.window:
            self._close(pieces)
        elif fill > self.window - self.step:
            self.nearly = (fill, pieces)
        else:
            self.open[fill // self.step].append((fill, pieces))
            self.n_open += 1

    def _place(self, piece: tuple) -> None:
        if self.nearly is not None:
            (fill, pieces), self.nearly = self.nearly, None
            doc_id, start, ids, total = piece
            room = self.window - fill
            self._put(fill, pieces, (doc_id, start, ids[:room], total))
            if len(ids) <= room:
                return
            piece = (doc_id, start + room, ids[room:], total)
        size, counts = len(piece[2]), [len(x) for x in self.open]
        best, chosen = None, None
        for level in range(-1, len(counts)):  # -1: a new window
            if level >= 0 and not counts[level]:
                continue
            fill = self.open[level][-1][0] if level >= 0 else 0
            if fill + size > self.window:
                continue
            after = (fill + size) // self.step if fill + size <= self.window - self.step else -1
            # The sum of squares after the move, less the sum before it.
            change = 0 if after == level else (2 * counts[after] + 1 if after >= 0 else 0) - (2 * counts[level] - 1 if level >= 0 else 0)
            if best is None or change <= best:  # of equals, the fullest
                best, chosen = change, level
        fill, pieces = self.open[chosen].pop() if chosen >= 0 else (0, [])
        self.n_open -= chosen >= 0
        self._put(fill, pieces, piece)
        if self.n_open > self.most_open:
            self._refill()

    def _refill(self) -> list[tuple]:
        """Fill the open windows from one another; what is left over stays as one open window."""
        windows = ([self.nearly] if self.nearly is not None else []) + [w for level in reversed(self.open) for w in level]
        self.refilled += sum(fill for fill, _ in windows)
        self.open, self.nearly, self.n_open = [[] for _ in self.open], None, 0
        filling, room = [], self.window
        for doc_id, start, ids, total in [p for _, pieces in windows for p in pieces]:
            while len(ids):
                filling.append((doc_id, start, ids[:room], total))
                start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                if not room:
                    self._close(filling)
                    filling, room = [], self.window
        if filling:
            self.open[(self.window - room) // self.step].append((self.window - room, filling))
            self.n_open = 1
        return filling

    def finish(self) -> None:
        """Refill, then cut the last window at powers of two."""
        pieces = self._refill()
        size, bit = sum(len(p[2]) for p in pieces), 1
        while size:
            bit = 1 << (size.bit_length() - 1)
            own, room = [], bit
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                own.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(own[-1][2])
            self._close(own)
            size -= bit

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = list(zip(*self.done)) or [()] * len(names)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


_tokens: dict[str, WordTokens] = {}


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, most_open: int = 4096) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `window` tokens; one row per piece, see PIECES.

    A document is its token ids and `end_id`. Null text is empty text: one piece, the end id. Repeated rows and rows
    with a null doc_id are packed each by itself; an empty table gives no rows; other columns are ignored.
    A sequence shorter than the window has a power of two as its length. `tokenizer` is a path that every executor has.
    """
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokens.get(tokenizer) or _tokens.setdefault(tokenizer, WordTokens(tokenizer))
        packer = SumOfSquares(window, most_open, TaskContext.get().partitionId() << 40)
        last = np.array([end_id], dtype=np.uint32)
        for frame in frames:
            texts, names = as_strings(frame.column("text")), frame.column("doc_id").to_pylist()
            for low, high in slices(texts, 12 << 20):
                for doc_id, ids in zip(names[low:high], words.encode(texts.slice(low, high - low))):
                    packer.add(doc_id, np.concatenate([ids, last]))
            yield packer.take()
        packer.finish()
        yield packer.take()
        words.forget()  # the worker lives on, and may run other stages
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
