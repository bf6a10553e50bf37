"""SentencePiece encoding and decoding by a streaming Viterbi search with a bounded window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm.common import map_rows

SPACE = "▁"
COMMIT_EVERY = 64  # characters between looks for a boundary that all paths share
MEMO_ENTRIES, PAIR_ENTRIES = 700_000, 1_000_000
MEMO_CHARS = 48
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  # piece types of the model format
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Viterbi:
    """The ids of a text under a pair-merging model, found left to right.

    The merges of a text are the one path through its pieces on which every two neighbours stay apart when merged alone, and
    every prefix has exactly one such path. So each boundary keeps one backpointer: to the boundary before the piece that
    ends there, a piece that stays apart from the last piece of that boundary. Only the boundaries that a longest piece
    can still reach back to are needed; ids before a boundary that the paths of all of them share are final.

    Whether two pieces stay apart is asked of the ``sentencepiece`` library once and remembered. A character without
    a piece stands alone and becomes its UTF-8 bytes.
    """

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        self.prefixed = model.normalizer_spec.add_dummy_prefix
        model.normalizer_spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.surface = [b"" if p.type not in (NORMAL, USER, BYTE) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}  # by characters; the id of a piece stands under the empty string
        for piece, number in self.ids.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = number
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.apart: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    def _stays_apart(self, key: int, left: int, right: int) -> bool:
        """Whether merging two pieces together gives these two again; ``left`` is negative where a text begins."""
        if len(self.apart) >= PAIR_ENTRIES:
            self.apart.clear()
        own = [left, right] if left >= 0 else [right]
        text = self.pieces[left] + self.pieces[right] if left >= 0 else self.pieces[right]
        known = self.apart[key] = self.library.encode(text) == own
        return known

    def _commits(self, text: str) -> Iterator[list[str | int]]:
        """Ids of ``text`` in order (characters without a piece as themselves), handed on as soon as they are final."""
        root, known, longest, size = self.trie, self.apart.get, self.longest, len(text)
        done, ahead = 0, [0] * (longest + 1)
        before, last = [0, *ahead], [-1, *([None] * (longest + 1))]  # by boundary from ``done`` on; None: no piece ends there yet
        for start in range(size):
            at = start - done
            left = last[at]
            if left is None:
                before[at], left = start - 1, -1
                last[at] = -1
            before.append(0)
            last.append(None)
            node, end = root, at
            for char in text[start : start + longest]:
                node = node.get(char)
                if node is None:
                    break
                end += 1
                piece = node.get("")
                if piece is not None and last[end] is None:
                    key = left << 32 | piece
                    apart = known(key)
                    if apart or (apart is None and self._stays_apart(key, left, piece)):
                        before[end], last[end] = start, piece
            if at >= COMMIT_EVERY and start % longest == 0:
                shared = self._shared(before, [at, *(j for j in range(at + 1, at + longest + 1) if last[j] is not None)], done)
                if shared > done:
                    yield self._path(text, before, last, shared, done)
                    before, last, done = before[shared - done :], last[shared - done :], shared
        if size > done:
            if last[size - done] is None:
                before[size - done], last[size - done] = size - 1, -1
            yield self._path(text, before, last, size, done)

    @staticmethod
    def _shared(before: list[int], ends: list[int], done: int) -> int:
        """The last boundary that lies on the paths of all of ``ends``, which count from ``done``."""
        common: set[int] | None = None
        for at in ends:
            at += done
            path = {at}
            while at > done:
                at = before[at - done]
                path.add(at)
            common = path if common is None else common & path
        return max(common)

    @staticmethod
    def _path(text: str, before: list[int], last: list[int], end: int, done: int) -> list[str | int]:
        out: list[str | int] = []
        while end > done:
            piece = last[end - done]
            out.append(piece if piece >= 0 else text[end - 1])
            end = before[end - done]
        return out[::-1]

    def _segment(self, segment: str) -> bytes:
        known = self.memo.get(segment)
        if known is not None:
            return known
        inside = self.inside
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in inside]
        if cuts:  # no piece has these two characters side by side, so all paths meet between them
            packed = b"".join([self._segment(segment[a:b]) for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)])
            return self._remember(segment, packed)
        out: list[int] = []
        for ids in self._commits(segment):
            for found in ids:
                if isinstance(found, int):
                    out.append(found)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in found.encode("utf-8", "surrogatepass"))
                else:
                    out.append(self.unknown)
        return self._remember(segment, np.asarray(out, dtype="<u4").tobytes())

    def _remember(self, segment: str, packed: bytes) -> bytes:
        if len(segment) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[segment] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers. No piece runs from a letter into a space, so all paths
        meet before each run of spaces: a text is searched run by run, and short runs are remembered."""
        if not text:
            return b""
        marked = (SPACE if self.prefixed else "") + text.replace(" ", SPACE)
        head = len(marked) - len(marked.lstrip(SPACE)) if marked[0] == SPACE else -1
        if head < 0:
            cut = marked.find(SPACE)
            first, marked = (marked, "") if cut < 0 else (marked[:cut], marked[cut:])
            return self._segment(first) + b"".join(map(self._segment, _SEGMENT.findall(marked)))
        return b"".join(map(self._segment, _SEGMENT.findall(marked)))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; unknown ids give nothing, broken bytes the replacement character."""
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < len(surface)]).decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the SentencePiece ids of every whole text, as little-endian unsigned 32-bit integers.

    The ids are those of the library. A null or empty text has no ids. Texts of any length take a window of
    bounded size, runs without a space too. Repeated rows and null ids stay as they are, an empty table gives no
    rows, other columns are ignored. Nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Viterbi(model_path)
        for batch in batches:
            packed = [search.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) from ``encode``. Null ids give an empty text.

    A text comes back as it was, but for characters U+2581, which the format cannot tell from a space.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Viterbi(model_path)
        for batch in batches:
            texts = [search.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded, same): each text encoded, decoded again, and whether it came back unchanged.

    A null text counts as empty. Same cases as ``encode`` and ``decode``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Viterbi(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed = [search.encode(t) for t in texts]
            decoded = [search.decode(p) for p in packed]
            same = [a == b for a, b in zip(texts, decoded, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.string()), pa.array(same)], names=["doc_id", "ids", "decoded", "same"]
            )

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, ids binary, decoded string, same boolean")
