"""Bounded-space online packing of token sequences into fixed windows.

Every task reads its documents once and keeps ``open_windows`` windows open. A document longer than
a window gives full windows first; what remains goes into the open window that it fills best. When
it fits none, the fullest window is emitted and a new one opened. The windows that are still open
at the end of a task are merged with those of neighbouring tasks, best fit by decreasing size.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; rows
without ``doc_id`` are packed with a null id; an empty table gives no pieces. Only ``doc_id``
and ``text`` are read, so names of further columns do not matter.
"""

import zlib
from bisect import bisect_left, insort
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import common
from catalogspark.session import freeze

WINDOW = 2048
OPEN_WINDOWS = 64
# Tasks whose open windows are merged together.
MERGED_TASKS = 16
END_ID = 1
# Bytes of words and their ids that a worker remembers, what Python keeps for each entry included.
KNOWN_BYTES = 48 << 20
ENTRY_BYTES = 180
# Longer words are encoded each time they are met, and not remembered.
LONG_WORD = 128

_TASK_BITS = 32


def _byte_letters() -> list:
    """The letters that byte-level vocabularies write for the 256 bytes (a fixed public rule)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Ids (little-endian 32 bits) of words between ASCII white space, for a lower-casing word tokenizer.

    The pre-tokenizer of such a vocabulary never joins text across white space, so a text's ids are
    those of its words in turn. Plain Latin words go straight to the model; a comma or full stop
    after a letter is a token of its own.
    """

    def __init__(self, path: str, limit: int = KNOWN_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.letters = Tokenizer.from_file(path), limit, _byte_letters()
        self.model, self.bytes = self.tokenizer.model, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self._ids(word)
        if len(word) > LONG_WORD:
            return ids
        if self.bytes >= self.limit:
            self.clear()
            self.bytes = 0
        self[word] = ids
        self.bytes += ENTRY_BYTES + len(word) + len(ids)
        return ids

    def _ids(self, word: bytes) -> bytes:
        # Most new words are plain ASCII: these need no decoding to tell what they are, and are spelled as they stand.
        if word.isalpha():
            return self._of_letters(word.decode()) if word.islower() else self[word.lower()]
        if word[-1:] in (b".", b",") and word[-2:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode()
        if text.isalpha() and max(text) < "Ā":
            low = text.lower()
            if low != text:
                return self[low.encode()]
            return self._of_letters("".join([self.letters[b] for b in word]))
        if text[-1] in ".," and len(text) > 1 and text[-2].isalpha() and text[-2] < "Ā":
            return self[word[:-1]] + self[word[-1:]]
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _of_letters(self, spelled: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def of_text(self, text: bytes) -> bytes:
        words = text.split()
        return b"".join(itemgetter(*words)(self)) if len(words) > 1 else b"".join([self[w] for w in words])


class Windows:
    """Open windows of one task."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made = size, most, [], 0

    def place(self, length: int) -> tuple[int, int, list]:
        """Window number and offset of a piece, and the windows that this closes."""
        closed = []
        if length == self.size:
            self.made += 1
            return self.made - 1, 0, [self.made - 1]
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                closed.append(self.open.pop(0)[1])
            free, window = self.size, self.made
            self.made += 1
        if free > length:
            insort(self.open, (free - length, window))
        else:
            closed.append(window)
        return window, self.size - free, closed


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a word vocabulary file, readable on every machine.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema([*fields, ("task", pa.int64()), ("is_open", pa.bool_())])
    end = np.array([end_id], "<u4").tobytes()

    def pieces(stream):
        known = common.worker_state(f"ids of {tokenizer}", lambda: WordIds(tokenizer))
        task = TaskContext.get().partitionId()
        windows, waiting = Windows(window, open_windows), {}

        def rows_of(numbers, is_open):
            rows = [(*row, task, is_open) for n in numbers for row in waiting.pop(n)]
            return common.batch_of(schema, list(zip(*rows)) or [[] for _ in schema])

        for batch in stream:
            done = []
            for doc, text in zip(batch.column(0).to_pylist(), common.filled(batch.column(1))):
                ids = known.of_text(text.as_py().encode()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start:4 * (start + window)]
                    length = len(part) // 4
                    number, offset, closed = windows.place(length)
                    row = (doc, start, length, zlib.crc32(part), total, (task << _TASK_BITS) | number, offset)
                    waiting.setdefault(number, []).append((*row, part) if with_ids else row)
                    done += closed
            yield rows_of(done, False)
        yield rows_of([n for _, n in windows.open], True)

    types = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    types += ", ids binary" if with_ids else ""
    # Stored once: both halves below read it, and tokenizing is the dear part.
    placed = freeze(
        common.small_batches(docs).select(F.col("doc_id").cast("bigint"), "text")
        .mapInArrow(common.tidy(pieces), f"{types}, task bigint, is_open boolean")
    )
    emitted = placed.filter(~F.col("is_open")).drop("task", "is_open")
    left = placed.filter("is_open").withColumn("team", F.floor(F.col("task") / MERGED_TASKS))
    columns = [n for n, _ in fields]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        fill = rows.groupby("sequence_id")["length"].sum().sort_index().sort_values(ascending=False, kind="stable")
        open_, home = [], {}
        for number, length in fill.items():
            at = bisect_left(open_, (int(length), -1))
            free, into = open_.pop(at) if at < len(open_) else (window, number)
            home[number] = (into, window - free)
            insort(open_, (free - int(length), into))
        moved = rows["sequence_id"].map(home)
        return rows.assign(
            sequence_id=moved.str[0].astype("int64"), offset=rows["offset"] + moved.str[1].astype("int64")
        )[columns]

    # At most MERGED_TASKS * open_windows windows meet in one group.
    return emitted.unionByName(left.groupBy("team").applyInPandas(merge, types))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, in order) of pieces packed with ``with_ids``; a window bounds each group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda whole, part: F.concat(whole, part["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
