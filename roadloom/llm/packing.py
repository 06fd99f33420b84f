"""Operator 5: packing documents into sequences by bounded-space online best fit.

Each task keeps `open_windows` open sequences.  A document's tokens come in pieces: whole sequences first, then its rest, which goes to the open window
that it fills best.  When none has room, the fullest is emitted: as it is if at most `tolerance` tokens are missing, else filled up with the head of
the piece, for documents may be cut anywhere.  What is open at a task's end is merged by fewer tasks in the same way, level by level, and the last
one joins what is left end to end, so one sequence in all may be short.  Each level is written before the next reads it.

A text is taken apart at white space, which the tokenizer drops, and the ids of each distinct string are kept: the ids are those of the whole text.
Texts with the separators 1C to 1F, which only Python takes for white space, are encoded whole.

Defined cases: a null or empty text is a document of the end token alone; texts of any length are packed whole; repeated rows are packed each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from roadloom.llm.common import Scratch, lean, shuffle_partitions, table

WINDOW, OPEN, TOLERANCE, END, FAN_IN = 2048, 64, 8, 1, 16
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open boolean"
ODD_SPACE = "\x1c\x1d\x1e\x1f"


#: Letters that a tokenizer can't compose or lower in more than one way, and what may follow them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """Strings without white space to the bytes of their ids; forgets all when it has grown large."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Encoder:
    """Texts to the bytes of their ids, unsigned little-endian 32-bit, with the end token.

    Ids are kept by string; a string of plain letters and marks that is new is made of the ids of its word, in lower case, and of its marks.
    """

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.words, self.marks, self.known = Known(self.word, most), Known(self.plain, 10_000), Known(self.string, most)
        self.end = np.array([END], "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def string(self, text: str) -> bytes:
        m = PLAIN.fullmatch(text)
        if not m:
            return self.plain(text)
        out = self.words[m[1].lower()]
        return out + self.marks[m[2]] if m[2] else out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if any(c in text for c in ODD_SPACE):
            return self.plain(text) + self.end
        return b"".join(map(self.known.__getitem__, text.split())) + self.end


_ENCODERS: dict[tuple[str, int], Encoder] = {}  # one for each Python worker


class Packer:
    def __init__(self, first_id: int, keep_ids: bool, window: int = WINDOW, open_windows: int = OPEN, tolerance: int = TOLERANCE):
        self.next, self.keep, self.window, self.most, self.tolerance = first_id, keep_ids, window, open_windows, tolerance
        self.open: list[list] = []  # [room, number, pieces], in order
        self.opened = 0
        self.out: list[tuple] = []

    def close(self, pieces: list[tuple], open_: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at, bytes(ids) if open_ or self.keep else None, open_))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc_id, start: int, ids: memoryview, total: int) -> None:
        n = len(ids) // 4
        while n >= self.window:
            self.close([(doc_id, start, ids[: 4 * self.window], total)])
            start, ids, n = start + self.window, ids[4 * self.window :], n - self.window
        while n:
            i = bisect_left(self.open, [n])  # the window with the least room that has enough
            if i < len(self.open):
                best = self.open.pop(i)
            elif len(self.open) < self.most:
                best = [self.window, self.opened, []]
                self.opened += 1
            else:
                fullest = self.open.pop(0)
                if (room := fullest[0]) > self.tolerance:
                    fullest[2].append((doc_id, start, ids[: 4 * room], total))
                    start, ids, n = start + room, ids[4 * room :], n - room
                self.close(fullest[2])
                continue
            best[2].append((doc_id, start, ids, total))
            best[0] -= n
            if best[0]:
                insort(self.open, best)
            else:
                self.close(best[2])
            return

    def leave(self) -> None:
        """The open windows, for the next level."""
        for _, _, pieces in self.open:
            self.close(pieces, True)
        self.open = []

    def join(self) -> None:
        """The open windows end to end."""
        at, room = [], self.window
        for doc_id, start, ids, total in (p for _, _, pieces in self.open for p in pieces):
            while len(ids):
                head = ids[: 4 * room]
                at.append((doc_id, start, head, total))
                start, ids, room = start + len(head) // 4, ids[len(head) :], room - len(head) // 4
                if not room:
                    self.close(at)
                    at, room = [], self.window
        if at:
            self.close(at)
        self.open = []

    def frame(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "open"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))


def _first(level: int) -> int:
    from pyspark import TaskContext

    return (level << 58) + (TaskContext.get().partitionId() << 30)


def _pack_texts(path: str, cached: int, options: dict):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path, cached) not in _ENCODERS:
            _ENCODERS[path, cached] = Encoder(path, cached)
        encode, packer = _ENCODERS[path, cached], Packer(_first(0), **options)
        for frame in batches:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                ids = encode(text)
                packer.add(doc_id, 0, memoryview(ids), len(ids) // 4)
                if len(packer.out) >= 20_000:
                    yield packer.frame()
        packer.leave()
        yield packer.frame()

    return pack


def _pack_left(level: int, last: bool, options: dict):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(_first(level), **options)
        pieces = [(r.doc_id, r.start, r.ids, r.doc_tokens) for f in batches for r in f.assign(doc_id=f["doc_id"].astype("Int64")).itertuples(index=False)]
        pieces.sort(key=lambda p: (-len(p[2]), p[0] is pd.NA, 0 if p[0] is pd.NA else p[0], p[1]))  # large ones first, as for any bounded set
        for doc_id, start, ids, total in pieces:
            packer.add(doc_id, start, memoryview(ids), total)
        packer.join() if last else packer.leave()
        yield packer.frame()

    return pack


def packed(docs: DataFrame, path: str, keep_ids: bool = True, window: int = WINDOW, open_windows: int = OPEN, tolerance: int = TOLERANCE, cached: int = 900_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (as bytes) if they are to be kept.  cached: strings whose ids a
    worker keeps at most, about 300 bytes each."""
    options = {"keep_ids": keep_ids, "window": window, "open_windows": open_windows, "tolerance": tolerance}
    scratch, tasks, level = Scratch(docs.sparkSession, "packing"), shuffle_partitions(docs.sparkSession), 0
    done = scratch.put(docs.select("doc_id", "text").mapInPandas(lean(_pack_texts(path, cached, options)), PIECES))
    out = done.where("not open")
    while tasks > 1:
        tasks, level = -(-tasks // FAN_IN), level + 1
        left = done.where("open").select("doc_id", "start", "ids", "doc_tokens", "sequence_id")
        left = left.repartition(tasks, "sequence_id") if tasks > 1 else left.coalesce(1)
        done = scratch.put(left.mapInPandas(lean(_pack_left(level, tasks == 1, options)), PIECES))
        out = out.union(done.where("not open"))
    if not level:
        out = out.union(scratch.put(done.where("open").coalesce(1).mapInPandas(lean(_pack_left(1, True, options)), PIECES)))
    return out.drop("open") if keep_ids else out.drop("open", "ids")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    out = packed(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
