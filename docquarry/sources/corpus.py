"""Files of JSON text: folders, zip archives, and decoding of their bytes."""

from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte-order marks; the longer come first, as UTF-16's begins UTF-32's.
MARKS = (("0000FEFF", "utf-32-be"), ("FFFE0000", "utf-32-le"), ("EFBBBF", "utf-8"), ("FEFF", "utf-16-be"), ("FFFE", "utf-16-le"))
TRIALS = ("utf-8", "utf-16-be", "utf-16-le", "utf-32-be", "utf-32-le")


def files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, content) of a folder's files and those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def wanted_files(spark: SparkSession, folder: str, wanted: DataFrame, name: str = "name") -> DataFrame:
    """The rows of ``wanted`` with ``content`` of the file of that name in the folder, or ``error`` where there is none."""
    there = files(spark, folder, "*").select(F.element_at(F.split("path", "/"), -1).alias("__file"), "content")
    joined = wanted.join(there, F.col(name) == F.col("__file"), "left")
    missing = F.when(F.col("__file").isNull(), F.concat(F.lit("LOCAL_FILE_NOT_FOUND: "), F.col(name)))
    return joined.withColumn("error", missing).drop("__file")


_MEMBER = "path string, packed binary, method int, size long, crc long, content binary, error string"


def _directory(path: str | None, content: bytes, suffix: str) -> Iterator[tuple]:
    """The members that an archive's directory lists, still packed; one row with an error for what is no archive."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield path, None, 0, 0, 0, None, f"no archive: {e}"
        return
    for m in sorted(z.infolist(), key=lambda m: m.filename):
        if not m.filename.endswith(suffix):
            continue
        name = f"{path}!{m.filename}"
        if m.flag_bits & 1 or m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            yield name, None, 0, 0, 0, None, "encrypted, or packed by a method that is not read"
            continue
        head = content[m.header_offset : m.header_offset + 30]
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            yield name, None, 0, 0, 0, None, "no member where the directory says"
            continue
        start = m.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        yield name, content[start : start + m.compress_size], m.compress_type, m.file_size, m.CRC, None, None


def _unpacked(packed: bytes, method: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
    try:
        content = packed if method == zipfile.ZIP_STORED else zlib.decompress(packed, -15)
    except zlib.error as e:
        return None, f"broken member: {e}"
    if len(content) != size or zlib.crc32(content) != crc:
        return None, "broken member: other content than the directory says"
    return content, None


def zip_members(archives: DataFrame, suffix: str = ".json") -> DataFrame:
    """(path, content, error) of the members of zip archives (path, content).

    An archive that can't be read is a row with an error under its own path, and so
    is each broken member under its. The task that holds an archive only reads its
    directory and cuts the packed members out; these are dealt over all cores to be unpacked.
    """
    names = [x.split()[0] for x in _MEMBER.split(", ")]
    types = [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _directory(path, content.as_py() or b"", suffix):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, packed, method, size, crc, _, error in zip(*batch.columns, strict=True):
                content, why = (None, error.as_py()) if error.is_valid else _unpacked(packed.as_py(), method.as_py(), size.as_py(), crc.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([content], pa.binary()), pa.array([why], pa.string())], names=["path", "content", "error"])

    members = archives.select("path", "content").mapInArrow(listed, _MEMBER)
    return members.repartition(archives.sparkSession.sparkContext.defaultParallelism).mapInArrow(unpacked, "path string, content binary, error string")


def byte_order_mark(content: Column) -> Column:
    """The encoding that a byte-order mark names, NULL without one."""
    start = F.hex(F.substring(content, 1, 4))
    found = F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        found = F.when(start.startswith(mark), name).otherwise(found)
    return found


def _trial(content: bytes, charset: str) -> str | None:
    try:
        return codecs.decode(content, charset)
    except UnicodeDecodeError:
        return None


def _own_characters(e: UnicodeDecodeError) -> tuple[str, int]:
    """What a byte stands for where UTF-8 is broken: the number that lead and continuing bytes spell (overlong ones too), else the byte's own character."""
    at, b = e.start, e.object[e.start]
    n = 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 1
    rest = e.object[at + 1 : at + n]
    if n > 1 and len(rest) == n - 1 and all(x & 0xC0 == 0x80 for x in rest):
        point = b & (0x7F >> n)
        for x in rest:
            point = point << 6 | x & 0x3F
        if point <= 0x10FFFF:
            return (chr(point) if not 0xD800 <= point < 0xE000 else "?"), at + n  # half of a pair has no place in text
    return chr(b), at + 1


codecs.register_error("docquarry.own", _own_characters)


def decode_robustly(content: bytes) -> str:
    """Decoding that always gives text: by mark, else the first encoding that fits, else byte by byte."""
    for mark, name in MARKS:
        m = bytes.fromhex(mark)
        if content.startswith(m):
            text = _trial(content[len(m) :], name)
            if text is not None:
                return text
    for name in TRIALS:
        text = _trial(content, name)
        if text is not None and (name == "utf-8" or (text and text.lstrip()[:1] in '{["-0123456789tfn')):
            return text
    return content.decode("utf-8", "docquarry.own")


def decoded(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Add the text of binary content. What is plain UTF-8 is decoded in the JVM; only the rest goes to Python."""

    @F.pandas_udf(T.StringType())
    def robust(x):
        return x.map(lambda b: None if b is None else decode_robustly(bytes(b)))

    plain = F.try_validate_utf8(F.col(content).cast("string"))
    easy = plain.isNotNull() & byte_order_mark(F.col(content)).isNull()
    rest = F.when(~easy, F.col(content))
    return df.withColumn(out, F.when(easy, plain).otherwise(robust(rest)))
