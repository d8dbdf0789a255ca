"""Byte-level BPE: long texts in overlapping chunks, stitched where their pre-tokens meet, then encoded piece by piece."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

#: Code points of a chunk, and those of them that the next chunk holds too.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Longer texts, which only chunks without a stitch leave, are encoded by single pre-tokens: the library's own matcher gives up on endless white space.
LONGEST = 1 << 17
#: A pre-token that ends this near to the end of its chunk might be another in the whole text.
MARGIN = 4
#: Code points of texts whose ids leave a task together, whatever Spark hands to it at once.
SLICE = 1 << 20


class ByteBpe:
    """The ranks of a vocabulary file, applied to each match of the public pattern by itself."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._library = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self._classes = [regex.compile(one) for one in (r"\s", r"\p{L}", r"\p{N}")]
        self._bytes = pa.array([token for _, token in sorted((rank, token) for token, rank in table.items())], pa.binary())
        if [*range(len(table))] != sorted(table.values()):
            raise ValueError(f"the ranks of {ranks} leave gaps")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text whose end is the end of a pre-token, as int32."""
        if len(text) <= LONGEST:
            return np.array(self._library.encode_ordinary(text), dtype=np.int32)
        pieces = (self._library._encode_single_piece(match[0]) for match in self._pattern.finditer(text))
        return np.fromiter(chain.from_iterable(pieces), dtype=np.int32)

    def decode(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The tokens' bytes, gathered one behind the other, in rows that end after so many ids; an unknown id is an error."""
        taken = self._bytes.take(ids)
        places = np.frombuffer(taken.buffers()[1], dtype=np.int32, count=len(taken) + 1) if len(taken) else np.zeros(1, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(places[ends]), taken.buffers()[2] if len(taken) else pa.py_buffer(b"")])

    def borders(self, chunk: str, last: bool) -> list[int]:
        """Ends of the chunk's pre-tokens where a text may be stitched: what stands on either side makes each a border of the
        whole text's pre-tokens too, however the text goes on and wherever the chunk began.

        No match of the pattern goes on from a letter, number or sign to a character of another class, but for
        the contractions, which an apostrophe starts. White space may stand in front of all of them, so none is taken after it;
        nor is one beside a code point that the Unicode version at hand does not know, as the library may know it.
        """
        out = []
        for match in self._pattern.finditer(chunk):
            end = match.end()
            if end > len(chunk) - (0 if last else MARGIN) or end == len(chunk):
                break
            left, right = chunk[end - 1], chunk[end]
            if left != "'" and self._class(left) not in (0, self._class(right)) and "Cn" not in (unicodedata.category(left), unicodedata.category(right)):
                out.append(end)
        return out

    def _class(self, point: str) -> int:
        """0: white space; 1: a letter; 2: a number; 3: any other."""
        return next((n for n, one in enumerate(self._classes) if one.match(point)), len(self._classes))


@lru_cache(2)
def byte_bpe(ranks: str) -> ByteBpe:
    """One vocabulary for all batches and tasks of a worker."""
    return ByteBpe(ranks)


def _slices(batches: Iterator[pa.RecordBatch], ranks: str, decode: bool) -> Iterator[pa.RecordBatch]:
    """The rows' columns with ids, and with the bytes these stand for, in place of the text; no more rows at a time than hold ``SLICE`` code points."""
    for batch in batches:
        texts, others = batch["text"], batch.drop_columns("text")
        begin, size, each = 0, 0, []
        for n, text in enumerate(texts, 1):
            text = text.as_py()
            each.append(byte_bpe(ranks).encode(text))
            size += len(text)
            if size < SLICE and n < len(texts):
                continue
            ends, ids = np.concatenate([[0], np.cumsum([len(ids) for ids in each])]).astype(np.int32), pa.array(np.concatenate(each))
            columns = {"ids": pa.ListArray.from_arrays(pa.array(ends), ids)} | ({"decoded": byte_bpe(ranks).decode(ids, ends)} if decode else {})
            rows = others.slice(begin, n - begin)
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns.values()], names=[*rows.schema.names, *columns])
            begin, size, each = n, 0, []


def _encoded(texts: DataFrame, ranks: str, decode: bool = False) -> DataFrame:
    """The columns of ``texts``, which are longs but for the text, with ids in place of the text; with ``decode``, also their bytes, from the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _slices(batches, ranks, decode)

    keys = [name for name in texts.columns if name != "text"]
    return texts.select(*keys, "text").mapInArrow(run, ", ".join([*(f"{name} long" for name in keys), "ids array<int>", *["decoded binary"] * decode]))


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, k, text, last: each text in pieces that begin ``chunk`` code points apart and hold ``overlap`` more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*batch.columns):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(n):
                    part = text[k * chunk : (k + 1) * chunk + overlap] if k < n - 1 else text[k * chunk :]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([doc_id.as_py()], pa.int64()), pa.array([k], pa.int64()), pa.array([part], pa.string()), pa.array([k == n - 1])], names=["row", "doc_id", "k", "text", "last"])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, "row long, doc_id long, k long, text string, last boolean")


def _ends(ranks: str, chunk: int, overlap: int):
    """head and tail: the borders of a chunk in what it shares with the one before and the one after, as places in the chunk and in the next.

    Only what is shared is pre-tokenised: a border is one wherever the pattern began.
    """

    def run(texts: pa.Array, last: pa.Array) -> pa.Array:
        heads, tails, borders = [], [], byte_bpe(ranks).borders
        for text, ends in zip(texts, last):
            text, ends = text.as_py(), ends.as_py()
            heads.append([p for p in borders(text[: overlap + MARGIN], ends and len(text) <= overlap + MARGIN) if p < overlap])
            tails.append([] if ends else [p - MARGIN for p in borders(text[chunk - MARGIN :], False) if p >= MARGIN])
        return pa.StructArray.from_arrays([pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["head", "tail"])

    run.__annotations__ = {"texts": pa.Array, "last": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "head array<int>, tail array<int>").asNondeterministic()


def _stitched(chunks: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, segment, text: what lies between two stitches. Chunks that have no border in common stay in one segment."""
    ends = chunks.select("row", "k", _ends(ranks, chunk, overlap)(F.col("text"), F.col("last")).alias("e")).select("row", "k", "e.head", "e.tail")
    order = Window.partitionBy("row").orderBy("k")
    met = ends.withColumn("seam", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    met = met.withColumn("segment", F.max(F.when(F.col("seam").isNotNull() | (F.col("k") == 0), F.col("k"))).over(order))
    upto = F.when(F.lead("k").over(order).isNotNull(), chunk + F.coalesce(F.lead("seam").over(order), F.lit(0)))
    plan = met.select("row", "k", "segment", F.when(F.col("segment") == F.col("k"), F.coalesce("seam", F.lit(0))).otherwise(0).alias("begin"), upto.alias("upto"))
    size = F.coalesce("upto", F.length("text")) - F.col("begin")
    own = chunks.join(plan, ["row", "k"]).select("row", "doc_id", "segment", "k", F.substring("text", F.col("begin") + 1, size).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("k", "part")))
    return own.groupBy("row", "doc_id", "segment").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def encode(docs: DataFrame, *, ranks: str = "byte_bpe_multi_50k.tiktoken", chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """doc_id, ids: the byte-level BPE of each text of ``docs``, by the ranks of a public vocabulary; special tokens are ordinary text.
    With ``decode`` also decoded, the bytes that a row's ids stand for.

    A text of up to ``chunk`` code points is pre-tokenised and encoded as it comes, without a shuffle. A longer one is
    cut into chunks that overlap, so that many tasks share it: each is pre-tokenised by itself; two neighbours are
    stitched at the first border that both have in their overlap; what lies between two stitches is encoded, and the
    ids are put together in order. Neighbours without a common border, such as those of one endless word, are encoded as one. The
    chunks are written to the shared folder, so that the number of a row holds when a task runs again. A worker holds the ids of
    about ``SLICE`` code points; short texts are decoded where they were encoded, so a task needs one worker, not two.

    Null text counts as empty and has no ids. Repeated rows and rows with a null doc_id each give a row; an empty table gives none. Other columns are not read.
    """
    if not MARGIN < overlap < chunk:
        raise ValueError("the overlap must be longer than the margin and shorter than the chunk")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    short = _encoded(texts.where(F.length("text") <= chunk), ranks, decode)
    chunks = materialize(_chunks(texts.where(F.length("text") > chunk), chunk, overlap), "chunks")
    pieces = _encoded(_stitched(chunks, ranks, chunk, overlap), ranks)
    ordered = F.array_sort(F.collect_list(F.struct("segment", "ids")))
    whole = pieces.groupBy("row", "doc_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    return short.unionByName(whole.select("doc_id", "ids", *[decoded("ids", ranks).alias("decoded")] * decode))


def decoded(ids: Column | str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> Column:
    """The bytes that ids stand for, those of each joined to the next's; they need not be whole UTF-8. Null gives null; an unknown id fails."""

    def run(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0)
        out = byte_bpe(ranks).decode(lists.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pc.if_else(lists.is_valid(), out, None) if lists.null_count else out

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(ids)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), decode=True)
    listed = F.btrim(F.to_json("ids"), F.lit("[]"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
