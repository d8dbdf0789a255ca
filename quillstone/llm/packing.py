"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Rows of output that are gathered before they are handed to Spark.
ROWS_OUT = 8192


class TokenIds:
    """Ids of the byte-level BPE vocabulary as little-endian uint32 arrays.

    ``tokenizers`` defines the ids. The same vocabulary's rank file gives equal
    ids at about four times the speed, so texts take that way unless they hold
    the string of a special token, which only ``tokenizers`` turns into its id.
    """

    def __init__(self, vocabulary: str, ranks: str, end_id: int):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self._special = [token.content for token in self._exact.get_added_tokens_decoder().values()]
        self._end = end_id

    def __call__(self, text: str) -> np.ndarray:
        if any(token in text for token in self._special):
            ids = self._exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        ids.append(self._end)
        return np.array(ids, dtype="<u4")


class SumOfSquares:
    """Online packing into windows of ``capacity`` tokens.

    ``levels[h]`` counts the open windows filled to h. A piece of size s goes to
    the level (or to a new window) whose choice leaves the smallest sum of
    squares of these counts. Windows are written out when full. ``close`` (at
    the end, or for the emptier half when more than ``max_open`` are open) cuts
    the pieces of the emptiest windows to top up the fullest, so that one window
    at most stays partly filled.
    """

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The fill level to add to; 0 for a new window."""
        end = self.capacity - size
        best_level, best = 0, 2 * int(self.levels[size]) + 1 if size < self.capacity else 0
        if end >= 1:
            at = self.levels[1 : end + 1]
            change = 2 * (self.levels[1 + size : self.capacity + 1] - at) + 2
            change[-1] -= 1  # a full window counts no more
            change[at == 0] = np.iinfo(np.int64).max
            level = int(change.argmin())
            if change[level] < best:
                best_level = level + 1
        return best_level

    def add(self, piece: tuple) -> Iterator[list]:
        """piece: (key, start, ids, tokens of the document). Yields windows that are done."""
        size = len(piece[2])
        level = self.choose(size)
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        fill = level + size
        if fill == self.capacity:
            yield window
        else:
            self.open[fill].append(window)
            self.levels[fill] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                yield from self.close(self.max_open // 2)

    def close(self, keep: int = 0) -> Iterator[list]:
        """Empty the windows that are least full into the others until ``keep`` are open."""
        rest = [(level, window) for level in range(self.capacity + 1) for window in self.open[level]]
        low, high = 0, len(rest) - 1
        while high > low and high - low + 1 > keep:
            fill, window = rest[high]
            level, donor = rest[low]
            need = self.capacity - fill
            key, start, ids, tokens = donor.pop()
            taken = min(need, len(ids))
            window.append((key, start + len(ids) - taken, ids[len(ids) - taken :], tokens))
            if taken < len(ids):
                donor.append((key, start, ids[: len(ids) - taken], tokens))
            rest[high], rest[low] = (fill + taken, window), (level - taken, donor)
            if fill + taken == self.capacity:
                yield window
                high -= 1
            if not donor:
                low += 1
        left = rest[low : high + 1]
        self.levels[:] = 0
        self.open = [[] for _ in range(self.capacity + 1)]
        self.n_open = 0
        for fill, window in left:
            if not keep:
                yield window
            else:
                self.open[fill].append(window)
                self.levels[fill] += 1
                self.n_open += 1


def pack(
    docs: DataFrame,
    *,
    capacity: int = 2048,
    max_open: int = 4096,
    end_id: int = 1,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    One row per piece, with the columns of SCHEMA. Each partition packs its own
    documents in a single pass, with no shuffle: memory is the level array and
    at most ``max_open`` open windows. sequence_id holds the partition number in
    its upper bits, so a task that runs again gives the same rows.

    Null text counts as empty: such a document is the end id alone. Documents
    longer than a window give whole windows first; only their rest is packed.
    Rows with equal or null doc_id are packed as they come. Other columns are
    not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = TokenIds(vocabulary, ranks, end_id)
        packer = SumOfSquares(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for key, start, ids, tokens in window:
                rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows)], schema=_ARROW)
            rows.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens_of(text.as_py() or "")
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    emit([(key, start, ids[start : start + capacity], len(ids))])
                if whole < len(ids):
                    for window in packer.add((key, whole, ids[whole:].copy(), len(ids))):
                        emit(window)
                if len(rows) >= ROWS_OUT:
                    yield ready()
        for window in packer.close():
            emit(window)
        if rows:
            yield ready()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
