"""Archived files as Spark data sources that read them in pieces: their hashes, and the records of loan tapes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read, or made from what was read, at a time.
PIECE = 1 << 20
#: Records that are handed to Spark at a time.
ROWS = 2000


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system, place


def _files(path: str) -> list[str]:
    """The files of a path: itself, what is in the folder, or what a pattern in the last part matches; hidden ones are left out."""
    from fnmatch import fnmatch

    from pyarrow import fs

    pattern = path.rsplit("/", 1)[1] if any(c in path.rsplit("/", 1)[-1] for c in "*?[") else None
    system, place = _opened(path.rsplit("/", 1)[0] if pattern else path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File]
    names = [x.path for x in found if not x.base_name.startswith(("_", ".")) and (pattern is None or fnmatch(x.base_name, pattern))]
    prefix = path.split("://")[0] + "://" if "://" in path else "file://"
    return sorted(f"{prefix}{name}" for name in names)


def raw_pieces(uri: str) -> Iterator[bytes]:
    system, place = _opened(uri)
    with system.open_input_stream(place, compression=None) as stream:
        while piece := stream.read(PIECE):
            yield piece


def plain_pieces(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzipped pieces hold, member after member, never more than PIECE at a time; plain pieces pass. A member that is cut off is an error."""
    unzip = None
    for number, piece in enumerate(pieces):
        if number == 0 and piece[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
        if unzip is None:
            yield piece
            continue
        left = piece
        while left:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            if out := unzip.decompress(left, PIECE):
                yield out
            left = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
    if unzip is not None:
        if not unzip.eof:
            while out := unzip.decompress(unzip.unconsumed_tail, PIECE):
                yield out
        if not unzip.eof:
            raise EOFError("the archive is cut off")


class _OfFile(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    """One partition for each file, as a gzipped file has to be read from its start."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_OfFile(uri) for uri in _files(self.options["path"])]


class ArchiveSource(DataSource):
    """file, archived and original bytes with their SHA-256: a row for each file, gzipped or plain, read once and in pieces."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "file string, archived_bytes long, archived_sha256 string, original_bytes long, original_sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        archived, original, sizes = hashlib.sha256(), hashlib.sha256(), [0, 0]

        def counted() -> Iterator[bytes]:
            for piece in raw_pieces(partition.uri):
                archived.update(piece)
                sizes[0] += len(piece)
                yield piece

        for piece in plain_pieces(counted()):
            original.update(piece)
            sizes[1] += len(piece)
        yield partition.uri, sizes[0], archived.hexdigest(), sizes[1], original.hexdigest()


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ArchiveSource for a file, a folder or a pattern of files."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").load(path)


class TapeSource(DataSource):
    """file, fields: the records of XML tapes, gzipped or plain, as maps from a field's name to its texts.

    Options: namespace, root, row (names of the elements), repeatable (names, joined by commas), identity (names that must be there, and
    together differ within a file). Checked in the one pass that reads a file: the namespace of the root, of records and of fields, fields that repeat
    though they may not, known or not, and records of the same identity. Any of these is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "loan_tape"

    def schema(self) -> str:
        return "file string, fields map<string, array<string>>"

    def reader(self, schema) -> DataSourceReader:
        return TapeReader(self.options)


class TapeReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        o = self.options
        inside = f"{{{o['namespace']}}}"
        repeatable, identity = ({name for name in o.get(option, "").split(",") if name} for option in ("repeatable", "identity"))
        parser = ElementTree.XMLPullParser(("start", "end"))
        root, seen, held = None, set(), []
        where = partition.uri

        def record(element) -> list[tuple[str, list]]:
            fields: dict[str, list] = {}
            for child in element:
                if not child.tag.startswith(inside):
                    raise ValueError(f"unexpected namespace of {child.tag} in {where}")
                name = child.tag[len(inside) :]
                if name in fields and name not in repeatable:
                    raise ValueError(f"repeated element {name} in {where}")
                fields.setdefault(name, []).append(child.text)
            who = tuple((fields.get(name) or [None])[0] for name in sorted(identity))
            if identity and (who in seen or not all(who)):
                raise ValueError(f"duplicate or missing identity {who} in {where}")
            seen.add(who)
            return list(fields.items())

        def batch() -> pa.RecordBatch:
            kind = pa.map_(pa.string(), pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([pa.array([where] * len(held), pa.string()), pa.array(held, kind)], names=["file", "fields"])
            held.clear()
            return out

        def events() -> Iterator[tuple]:
            for piece in plain_pieces(raw_pieces(where)):
                parser.feed(piece)
                yield from parser.read_events()
            parser.close()
            yield from parser.read_events()

        for event, element in events():
            if root is None:
                root = element
                if element.tag != f"{inside}{o['root']}":
                    raise ValueError(f"unexpected root {element.tag} in {where}")
            elif event == "end" and element.tag == f"{inside}{o['row']}":
                held.append(record(element))
                root.clear()  # what was read is not kept
                if len(held) >= ROWS:
                    yield batch()
            elif event == "end" and element.tag.rpartition("}")[2] == o["row"]:
                raise ValueError(f"unexpected namespace of {element.tag} in {where}")
        if root is None:
            raise ValueError(f"no XML in {where}")
        if held:
            yield batch()


def tape_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of TapeSource."""
    spark.dataSource.register(TapeSource)
    return spark.read.format("loan_tape").options(**options).load(path)


def fields(records: DataFrame, names: list[str], many: tuple[str, ...] = ()) -> DataFrame:
    """file and a column for each name: the field's text, or all of its texts for the names in ``many``; absent fields are null."""
    one = lambda name: F.try_element_at("fields", F.lit(name))
    return records.select("file", *[(one(name) if name in many else F.get(one(name), F.lit(0))).alias(name) for name in names])
