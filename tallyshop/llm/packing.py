"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.common import map_rows

PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenBins:
    """A fixed number of open bins, found through a bitset with one bit per amount of free space.

    A piece goes to the open bin it fills best. If none has room, a bin is opened; when ``limit`` are open
    already, the fullest is closed first.
    """

    def __init__(self, length: int, limit: int, next_id: int):
        self.length, self.limit, self.next_id = length, limit, next_id
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size`` tokens."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.length, self.next_id
            self.next_id += 1
        left = free - size
        if left:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.length - free


class Tokens:
    """Ids of a text as little-endian 32-bit integers.

    A text is encoded whole, which costs less than looking up its words: a quarter of them are new to a task. Texts that spell a special
    token go to the ``tokenizers`` library itself.
    """

    def __init__(self, json_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.specials = [t.content for t in self.full.get_added_tokens_decoder().values()]
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in self.specials}
        self.encode = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_ordinary

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return _packed(self.full.encode(text, add_special_tokens=False).ids)
        return _packed(self.encode(text))


def _packed(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the
    others follow from code point 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document: only the first may be shorter than ``length``."""
    if total <= length:
        return [(0, total)]
    head = total % length
    starts = ([0] if head else []) + list(range(head, total, length))
    return [(s, (head if head and s == 0 else length)) for s in starts]


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, open_bins: int = 512) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, piece (from 0), start (ids of its document before it), length, ids
    (little-endian unsigned 32-bit integers), sequence_id and offset in the sequence, without gaps. Every
    input partition packs its own stream with ``open_bins`` open bins and numbers its sequences above those
    of other partitions, so nothing is shuffled, memory is fixed, and a lost task is repeated alone.

    Every row is packed, repeated rows and ids too. A null text is empty and takes the end id alone; a null
    doc_id stays null. Texts of any length are cut into full pieces after a shorter first one. An empty table
    gives no rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, bins = Tokens(tokenizer), OpenBins(length, open_bins, TaskContext.get().partitionId() << 40)
        end = _packed([end_id])
        for batch in batches:
            for ids, texts in ((batch.column(0)[i : i + 256], batch.column(1)[i : i + 256]) for i in range(0, len(batch), 256)):
                out: list[tuple] = []
                for doc, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                    packed = tokens.of(text or "") + end
                    for piece, (start, size) in enumerate(cut(len(packed) // 4, length)):
                        out.append((doc, piece, start, size, packed[4 * start : 4 * (start + size)], *bins.place(size)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _PACKED_TYPES, strict=True)], names=_PACKED_NAMES
                )

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work, PACKED)


_PACKED_NAMES = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
_PACKED_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
