"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of a model holds the whitespace marker after another character,
no merge can cross from one marked word into the next. Every distinct marked
word (the markers and what follows them) is then segmented once, and a text's
ids are the ids of its words joined by position. The table lives in each
Python worker and is bounded by the characters it holds; words too long to be
worth keeping are segmented where they stand. No row is shuffled.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated results; very long texts are encoded whole; an empty table gives an empty result; other
columns, whatever their names, are ignored. A model whose pieces cross markers, whose normaliser is
not the identity or that does not mark the text's start is encoded whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Words longer than this are not kept; the table is emptied at so many characters.
LONGEST_KEPT = 64
TABLE_CHARS = 1_000_000


class ChunkCodec:
    """Encodes like the library, by way of distinct chunks."""

    def __init__(self, model: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        bounded = all(MARK not in p.lstrip(MARK) for p in pieces)
        probe = " a\tb  ½　é "
        self.by_chunk = bounded and self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self._table: dict[str, list[int]] = {}
        self._chars = 0

    def _ids(self, chunk: str) -> list[int]:
        ids = self._table.get(chunk)
        if ids is None:
            ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else self._lone()
            if len(chunk) <= LONGEST_KEPT:
                if self._chars > TABLE_CHARS:
                    self._table.clear()
                    self._chars = 0
                self._table[chunk] = ids
                self._chars += len(chunk)
        return ids

    @functools.cache  # noqa: B019  one codec lives as long as its worker
    def _lone(self) -> list[int]:
        """A marker alone: the library has no text that gives it, but its doubled form shows how it is split."""
        whole = self.sp.piece_to_id(MARK)
        if not self.sp.is_unknown(whole):
            return [whole]
        tail = self.sp.encode("a" + " ")
        return tail[len(self.sp.encode("a")) :]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.by_chunk:
            return self.sp.encode(text)
        ids: list[int] = []
        for chunk in _CHUNK.findall(MARK + text.replace(" ", MARK)):
            ids += self._ids(chunk)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


@functools.lru_cache(maxsize=4)
def codec(model: str) -> ChunkCodec:
    """One codec per worker process and model."""
    return ChunkCodec(model)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, token ids and the text decoded from them, for every row.

    ``model`` is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [c.encode(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    bound_batches(docs.sparkSession)
    thin = docs.select(docs[id_col], docs[text_col])
    return thin.mapInArrow(run, f"{id_col} {thin.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def digest_encoding(encoded: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, from ``encode_documents``."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *([F.col("ids")] if keep_ids else []),
    )
