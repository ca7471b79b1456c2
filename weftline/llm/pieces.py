"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers with the word behind it, or a line feed with the word behind it. No piece of a
model of this kind holds a marker after another character, or a line feed beside another character, so that merges
never cross the border of a chunk: each distinct chunk is segmented once by the library, and a text's ids are those of
its chunks joined by position. open_model() checks both conditions on the model's pieces.

The table is kept by each Python worker in two generations of at most TABLE_BYTES, and given up at the end of a task. A
table for the whole corpus would have to be joined back by position, which moves every word of it. Texts of a model
whose pieces do cross markers are encoded as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import sha256_text, table

#: Bytes of one generation of a worker's table, what an entry takes beside its chunk and ids, and the characters from
#: which a chunk is segmented anew each time.
TABLE_BYTES, ENTRY_BYTES, LONG = 16 << 20, 190, 256

#: Chunks of a text that are looked up at a time.
PART = 100_000

MARK = "▁"

#: Chunks of a text behind its dummy prefix; every character is in one of them.
CHUNKS = re.compile(r" +[^ \n]*|\n[^ \n]*")

#: Without these, chunks are what a split at single spaces leaves.
UNEVEN = re.compile(r"  | \n|^[ \n]| $")


class Segmenter:
    """Ids and decoded text of whole texts, from a model's bytes."""

    def __init__(self, model: bytes, size: int = TABLE_BYTES) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size
        self.forget()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.mark_id = self.model.piece_to_id(MARK)
        #: Whether no piece crosses a border of chunks, and the model adds a dummy prefix and leaves whitespace alone.
        self.by_chunk = not any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in pieces) and not (
            self.model.encode("") or self.model.encode(" ")[:1] != [self.model.piece_to_id(MARK * 2)] or self.model.encode("\n")[:1] != [self.mark_id]
        )

    def forget(self) -> None:
        """Give up the table."""
        self.new, self.old, self.odd, self.held = {}, {}, {}, 0

    def _learn(self, keys: set[str], may_end: bool = True) -> dict[str, bytes]:
        """Segment chunks that the new generation lacks, which may end before; gives those that are too long for it. A
        key is a chunk without its first marker."""
        if may_end and self.held > self.size:
            self.old, self.new, self.held = self.new, {}, 0
            self.odd = {k: v for k, v in self.odd.items() if k in self.old}
        todo, long = [], {}
        for k in keys:
            if (found := self.old.get(k)) is None:
                todo.append(k)
            else:
                self._keep(k, found)
        found = self.model.encode(todo, num_threads=1)
        found = [ids[1:] if k[:1] == "\n" else ids or [self.mark_id] for k, ids in zip(todo, found)]
        for k, ids, back in zip(todo, found, self.model.decode(found, num_threads=1) if found else []):
            packed = array("i", ids).tobytes()
            if len(k) < LONG:
                self._keep(k, packed)
            else:
                long[k] = packed
            if back != k:
                self.odd[k] = back
        return long

    def _keep(self, key: str, ids: bytes) -> None:
        self.new[key] = ids
        self.held += len(key) + len(ids) + ENTRY_BYTES

    def __call__(self, text: str) -> tuple[bytes, str]:
        """The ids as int32 in bytes, without an end id, and the text that they decode to."""
        if not text:
            return b"", ""
        if not self.by_chunk:
            ids = self.model.encode(text)
            return array("i", ids).tobytes(), self.model.decode(ids)
        if MARK in text:
            text = text.replace(MARK, " ")
        if UNEVEN.search(text):
            keys = [c[1:] if c[0] == " " else c for c in CHUNKS.findall(" " + text)]
        else:
            keys = text.replace("\n", " \n").split(" ")
        ids, back = [], None
        for at in range(0, len(keys), PART):
            part = keys[at : at + PART]
            long: dict[str, bytes] = {}
            if new := set(part).difference(self.new):
                long = self._learn(new)
                if rest := set(part).difference(self.new, long):  # a generation has just ended
                    long |= self._learn(rest, False)
            ids.append(b"".join([self.new.get(k) or long[k] for k in part] if long else map(self.new.__getitem__, part)))
            if back is not None or self.odd and not self.odd.keys().isdisjoint(part):
                back = ["".join(k if k[:1] == "\n" else " " + k for k in keys[:at])] if back is None else back
                back.append("".join(self.odd.get(k, k) if k[:1] == "\n" else " " + self.odd.get(k, k) for k in part))
            for k in long:
                self.odd.pop(k, None)
        return b"".join(ids), text if back is None else "".join(back)[1:]


_open: dict[int, Segmenter] = {}


def open_model(model: bytes) -> Segmenter:
    """The segmenter of this process; reused workers keep the model."""
    if (key := hash(model)) not in _open:
        _open.clear()
        _open[key] = Segmenter(model)
    return _open[key]


def encode(docs: DataFrame, model_path: str, end_id: bool = True, columns: Iterable[str] = ("doc_id",)) -> DataFrame:
    """columns of docs with ids (array<int>) and decoded (the text from the library's decoding of ids).

    Works on docs' whole texts, one output row for each row, repeated rows included. A null or empty text has only
    the end id, and decodes to the empty text. Columns named ids or decoded cannot be carried. The model file is read
    by the driver and sent to the workers; an empty table gives no rows. Any model of the library will do.
    """
    columns = list(columns)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def segment(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = open_model(model.value)
        last = np.array([run.model.eos_id()] * end_id, np.int32).tobytes()
        try:
            for frame in frames:
                for at in range(0, frame.num_rows, 1000):  # bounds what is held beside the input
                    part = frame.slice(at, 1000)
                    blobs, decoded = [], []
                    for text in part.column(len(columns)):
                        ids, back = run(text.as_py() or "")
                        blobs.append(ids + last)
                        decoded.append(back)
                    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], ids, pa.array(decoded, pa.string())], names=[*columns, "ids", "decoded"])
        finally:
            run.forget()

    if {"text", "ids", "decoded"} & set(columns):
        raise ValueError("text, ids and decoded cannot be carried; decoded holds the text")
    carried = docs.select(*columns)
    schema = T.StructType([*carried.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(*columns, "text").mapInArrow(segment, schema)


def digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(ids).alias("ids_sha256"), sha256_text(F.col("decoded")).alias("decoded_sha256"),
    )


def model_path() -> str:
    """The vocabulary file of the production query."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), model_path()))
