"""FASTA scans and sinks, as DataFrames.

Files are split into records by Spark's own text reader (plain or gzip); record
numbers come from the place in the file, so ids are dense and in input order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import revcomp
from ..operators.numbering import cumulative
from ..staging import stage

#: Suffixes of nucleotide files.
SUFFIXES = (".fasta", ".fa", ".fna", ".ffn", ".fas")
COLUMNS = ("sequence_id", "fasta_id", "description", "source_file", "sequence", "orientation")


def parse_records(raw: DataFrame) -> DataFrame:
    """``(fasta_id, description, source_file, sequence)`` of raw records in ``value``; blank ones are dropped."""
    record = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s+", "")
    out = raw.select(F.trim(header).alias("description"), body.alias("sequence"), *[c for c in raw.columns if c != "value"])
    return out.where("description <> '' or sequence <> ''").withColumn("fasta_id", F.split("description", r"\s+")[0])


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records ``(fasta_id, description, source_file, sequence)`` of files or folders."""
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    return parse_records(raw)


def _opened(path: str):
    """``(file system, path in it, what to put before such paths)``; raises for what pyarrow can't open."""
    from pyarrow import fs

    if not re.match(r"\w+:/", path):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path), "file:"
    files, base = fs.FileSystem.from_uri(path)
    return files, base, path[: path.rindex(base)] if base in path else path[: path.index(":/") + 3]


def _can_open(path: str) -> bool:
    try:
        _opened(path)
    except Exception:  # noqa: BLE001  (what it raises depends on the scheme)
        return False
    return True


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 8192 rows or about ``size`` characters."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == 8192 or n > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _list(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``(file, name, path, length, level)``: files as they are; a folder's files, and its folders at level 1, or all below for those."""
    from pyarrow import fs

    def below(files, path: str, before: str, file: int, name: str, level: int) -> Iterator[tuple]:  # noqa: ANN001
        for one in files.get_file_info(fs.FileSelector(path)):
            here = f"{name}/{one.base_name}" if name else one.base_name
            if _hidden(one.base_name):
                continue
            if one.type != fs.FileType.Directory:
                yield file, here, before + one.path, one.size, 2
            elif level:
                yield from below(files, one.path, before, file, here, level)
            else:
                yield file, here, before + one.path, None, 1

    def found() -> Iterator[tuple]:
        for file, name, path, length, level in _rows_of(batches):
            if level == 2:
                yield file, name, path, length, level
                continue
            files, inner, before = _opened(path)
            one = files.get_file_info(inner)
            if one.type == fs.FileType.Directory:
                yield from below(files, inner, before, file, name, level)
            else:
                yield file, name, before + inner if one.type == fs.FileType.File else path, one.size if one.type == fs.FileType.File else -1, 2

    yield from _in_batches(found(), pa.schema([("file", pa.int32()), ("name", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("level", pa.int32())]))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def listed(spark: SparkSession, roots: list[tuple[int, str]]) -> DataFrame:
    """``(file, name, path, length)`` of the files at or below numbered paths, by tasks: no names go through the driver.

    A path's own folder is listed by one task and each folder in it by another,
    so many files want folders of their own.  ``name`` is what stands below the
    path; a path that is missing has length -1.
    """
    kind = "file int, name string, path string, length long, level int"
    asked = spark.createDataFrame([(i, "", p, None, 0) for i, p in roots], kind)
    asked = asked.repartition(_partitions(spark)) if len(roots) > 1 else asked
    return asked.mapInArrow(_list, kind).repartition(_partitions(spark)).mapInArrow(_list, kind).drop("level")


#: Bytes of a file that a task reads whole; larger ones, and packed ones, go through Spark's reader, which splits them.
SMALL = 4 << 20
_PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd)$"


def _blank(record: str) -> bool:
    """Whether :func:`parse_records` drops it."""
    head = re.match(r"[^\r\n]*", record.removeprefix(">"))[0]
    return not head.strip(" ") and not re.search(r"[^ \t\n\x0b\f\r]", record.removeprefix(">")[len(head) :])


def _read_small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``(no, path)``: ``(no, source_file, rank, value)``, records that are not blank by their place in the file."""

    def records() -> Iterator[tuple]:
        for no, path in _rows_of(batches):
            files, inner, _ = _opened(path)
            with files.open_input_stream(inner, compression=None) as at:
                text = at.read().decode(errors="replace")
            for rank, value in enumerate(r for r in text.split("\n>") if not _blank(r)):
                yield no, path, rank, value

    yield from _in_batches(records(), pa.schema([("no", pa.int64()), ("source_file", pa.string()), ("rank", pa.int64()), ("value", pa.string())]))


def _expanded(spark: SparkSession, paths: list[str]) -> list[tuple[int, str]]:
    """Numbered paths, with those that are patterns matched at the driver."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for i, p in enumerate(paths):
        if not re.search(r"[*?\[\]{}\\]", p) and _can_open(p):
            out.append((i, p))
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = [s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or []]
        if not found:
            raise ValueError(f"The file {p} does not exist")
        out += [(i, f) for f in found]
    return out


def _files_by_spark(spark: SparkSession, roots: list[tuple[int, str]]) -> list[tuple]:
    """:func:`listed` at the driver, for paths that pyarrow can't open; without lengths."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for i, p in roots:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf)
        found = files.listFiles(path, True)
        while found.hasNext():
            one = found.next().getPath().toString()
            name = one[len(files.makeQualified(path).toString()) + 1 :]
            if not any(_hidden(x) for x in name.split("/") if x):
                out.append((i, name, one, None))
    return out


def load_contigs(spark: SparkSession, paths: list[str], *, reverse_complement: bool = True, uppercase: bool = False) -> DataFrame:
    """The sequence table: records numbered in the order of files and places.

    With ``reverse_complement`` record ``i`` gives rows ``2i`` (forward) and
    ``2i + 1`` (reverse).  Files are listed and numbered by tasks, in the order
    of ``paths`` and below a folder by name, so any number of them may lie in
    few folders.  Small files are read whole, many by a task, and their records
    staged; large and packed ones are one scan of Spark's reader, numbered
    within its splits, so a large file is several tasks.  A file that is named
    twice is read twice.
    """
    roots = _expanded(spark, paths)
    ours, theirs = [r for r in roots if _can_open(r[1])], [r for r in roots if not _can_open(r[1])]
    found = listed(spark, ours)
    if theirs:
        found = found.unionByName(spark.createDataFrame(_files_by_spark(spark, theirs), "file int, name string, path string, length long"))
    files = stage(found.orderBy("file", "name", "path").withColumn("no", F.monotonically_increasing_id()), "files")
    if missing := files.where("length < 0").first():
        raise ValueError(f"The file {missing['path']} does not exist")
    few = files.where(F.col("length").isNull() | (F.col("length") > SMALL) | F.col("path").rlike(_PACKED))
    large = sorted({r["path"] for r in few.select("path").collect()})  # of at least SMALL bytes, or packed

    small = files.where((F.col("length") <= SMALL) & ~F.col("path").rlike(_PACKED)).select("no", "path")
    small = small.repartition(_partitions(spark)).mapInArrow(_read_small, "no long, source_file string, rank long, value string")
    rows = stage(parse_records(small), "records")
    counts = rows.groupBy("no").agg(F.count("*").alias("_n"))
    if large:
        raw = spark.read.option("lineSep", "\n>").text(large).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
        # the reader writes a name with one stroke or three after its scheme, and signs by their codes
        order = spark.createDataFrame([(p, re.sub(r"^(\w+):/+", r"\1:/", spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString())) for p in large], "path string, name string")
        order = few.select("no", "path").join(order, "path").drop("path")
        split = parse_records(raw).withColumn("name", F.regexp_replace("source_file", r"^(\w+):/+", "$1:/")).join(order, "name").drop("name")
        splits = split.groupBy("no", "block").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
        starts = splits.select("no", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy("no", "block").orderBy("pos")) - 1
        split = split.withColumn("_place", place).join(starts, ["no", "block"]).withColumn("rank", F.col("_before") + F.col("_place"))
        rows = rows.unionByName(split.select(*rows.columns))
        counts = counts.unionByName(splits.groupBy("no").agg(F.sum("_n").alias("_n")))
    starts = cumulative(counts, "no", "_n", "_upto").select("no", (F.col("_upto") - F.col("_n")).alias("_start"))
    rows = rows.join(starts, "no").withColumn("record", (F.col("_start") + F.col("rank")).cast("long"))
    seq = F.upper("sequence") if uppercase else F.col("sequence")
    rows = rows.withColumn("sequence", seq)
    if not reverse_complement:
        return rows.select(F.col("record").alias("sequence_id"), "fasta_id", "description", "source_file", "sequence", F.lit("forward").alias("orientation"))
    return with_reverse(rows, "record")


def with_reverse(rows: DataFrame, record: str) -> DataFrame:
    """Each record forward and reversed, as rows ``2i`` and ``2i + 1``."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("sequence").alias("s"), F.lit("forward").alias("o")), F.struct(F.lit(1).alias("r"), revcomp("sequence").alias("s"), F.lit("reverse").alias("o"))))
    return rows.select("*", both.alias("_b")).select((F.col(record) * 2 + F.col("_b.r")).cast("long").alias("sequence_id"), "fasta_id", "description", "source_file", F.col("_b.s").alias("sequence"), F.col("_b.o").alias("orientation"))


def _first_is_nucleotide(at) -> bool:  # noqa: ANN001
    """Whether a stream's first record, up to ``\\n>``, has a header and else only ACGTN and white space; read no further than needed."""
    chunk, body = at.read(1 << 16), False
    if chunk[:1] != b">":
        return False
    last = b""
    while chunk:
        if not body and (found := re.search(rb"[\r\n]", chunk)):
            chunk, body = chunk[found.start() :], True
        if body:
            chunk = last + chunk
            end = chunk.find(b"\n>")
            if re.search(rb"[^ACGTNacgtn\s]", chunk[:end] if end >= 0 else chunk):
                return False
            if end >= 0:
                return True
            last = chunk[-1:]
        chunk = at.read(1 << 20)
    return True


def _nucleotide_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for path in batch.column(0).to_pylist():
            files, inner, _ = _opened(path)
            with files.open_input_stream(inner, compression=None) as at:
                keep.append(_first_is_nucleotide(at))
        yield batch.filter(pa.array(keep, pa.bool_()))


def find_nucleotide_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path)`` of files below with a nucleotide suffix whose first record is of ACGTN alone.

    Tasks list the folders and read first records, many files each; folders that
    pyarrow can't open are scanned by Spark's reader.
    """
    pattern = r"(?i)\.(" + "|".join(s[1:] for s in SUFFIXES) + ")$"
    if _can_open(directory):
        found = listed(spark, [(0, directory)])
        return found.where((F.col("length") > 0) & F.col("path").rlike(pattern)).select("path").mapInArrow(_nucleotide_paths, "path string")
    files = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).text(directory).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    first = files.where(F.col("path").rlike(pattern)).groupBy("path").agg(F.min_by("value", F.struct("block", "pos")).alias("value"))
    body = F.regexp_replace(F.regexp_replace("value", r"^>?[^\r\n]*", ""), r"\s+", "")
    return first.where(F.col("value").startswith(">") & body.rlike("^[ACGTNacgtn]*$")).select("path")


def non_empty_files(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (".fasta", ".fna")) -> DataFrame:
    """``(path, length)`` of files below with one of the suffixes, or it and ``.gz``, that hold anything; tasks list the folders."""
    pattern = "(" + "|".join(re.escape(s) for s in suffixes) + r")(\.gz)?$"
    if _can_open(directory):
        found = listed(spark, [(0, directory)]).select("path", "length")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length")
    return found.where((F.col("length") > 0) & F.col("path").rlike(pattern))


def fasta_text(fasta_id: Column | str = "fasta_id", sequence: Column | str = "sequence", width: int = 60) -> Column:
    """A record as FASTA text with wrapped lines, without a last line end."""
    ident, seq = (F.col(c) if isinstance(c, str) else c for c in (fasta_id, sequence))
    return F.concat(F.lit(">"), ident.cast("string"), F.lit("\n"), F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n"))


def sequence_records(df: DataFrame, id_column: str = "test_fastaid", sequence_column: str = "sequence") -> DataFrame:
    """``(fasta_id, sequence)`` of any table; a missing column raises KeyError."""
    for c in (id_column, sequence_column):
        if c not in df.columns:
            raise KeyError(c)
    return df.select(F.col(id_column).cast("string").alias("fasta_id"), F.col(sequence_column).alias("sequence"))


def write_fasta(df: DataFrame, path: str, *, files: int | None = None, order: str | None = None) -> None:
    """A folder of FASTA text; ``files=1`` for a single part."""
    rows = df.orderBy(order) if order else df
    rows = rows.select(fasta_text().alias("value"))
    (rows.coalesce(files) if files else rows).write.mode("overwrite").text(path)


def write_fasta_per_record(df: DataFrame, path: str) -> None:
    """A folder for each record's id, named ``fasta_id=<id>``, by Spark's own writer."""
    df.select("fasta_id", fasta_text().alias("value")).write.mode("overwrite").partitionBy("fasta_id").text(path)


def write_fasta_files(df: DataFrame, path: str, folder: Column | None = None) -> None:
    """A file ``<fasta_id>.fasta`` for each record; signs that no file name may hold become underscores.

    ``folder`` names a folder for each record below ``path``, so that many files
    don't lie in one; readers list folders side by side.

    Each task writes its own records straight to the folder, which all executors
    must see, so a repeated attempt writes the same files again.  Records of one
    id share a file name, and one of them stays.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def write(batches):  # noqa: ANN001, ANN202
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        made = set()
        for batch in batches:
            for ident, text, below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = re.sub(r"[^\w.|=-]", "_", ident or "none")
                at = base.rstrip("/") + (f"/{below}" if below else "")
                if below and at not in made:
                    files.create_dir(at, recursive=True)
                    made.add(at)
                with files.open_output_stream(f"{at}/{name}.fasta") as out:
                    out.write(f"{text}\n".encode())
            yield batch.slice(0, 0)

    rows = df.select(F.col("fasta_id").cast("string").alias("fasta_id"), fasta_text().alias("value"), (F.lit("") if folder is None else folder).alias("folder"))
    rows.mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()


def greedy_chunks(sizes: np.ndarray, filled: float, chunk: int, limit: float) -> tuple[np.ndarray, float, int]:
    """Chunk numbers of records in order, and the last chunk's fill and number: a step for each chunk, not for each record.

    A record that would pass the limit opens a chunk, even if the one before is
    empty.
    """
    total, numbers, done = np.concatenate(([0.0], np.cumsum(sizes))), np.empty(len(sizes), np.int64), 0
    while done < len(sizes):
        to = max(done, int(np.searchsorted(total, total[done] + limit - filled, "right")) - 1)
        numbers[done:to] = chunk
        filled, done = filled + total[to] - total[done], to
        if done < len(sizes):
            chunk += 1
            numbers[done] = chunk
            filled, done = float(sizes[done]), done + 1
    return numbers, filled, chunk


def chunk_numbers(df: DataFrame, order: str, chunk_mb: float = 10, group: str | None = None) -> DataFrame:
    """``df`` with ``chunk``: records fill a chunk greedily until the next would pass the limit.

    The fill depends on all records before, so each ``group`` (say a file) is
    filled on its own, streaming through its sorted records; without a group
    the ordered table is one stream.  Numbers start at 1 in each group.
    """
    import pandas as pd

    limit = chunk_mb * 1024 * 1024
    keyed = df.withColumn("_group", F.col(group) if group else F.lit(0)).withColumn("_size", (F.length("sequence") + F.length("fasta_id") + 2).cast("double"))
    spread = keyed.repartition("_group").sortWithinPartitions("_group", order)

    def run(frames):  # noqa: ANN001, ANN202
        now, filled, chunk = None, 0.0, 1
        for pdf in frames:
            groups, sizes = pdf["_group"].to_numpy(), pdf["_size"].to_numpy()
            numbers, at = [np.empty(0, np.int64)], 0
            for end in [*(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else []:
                if groups[at] != now:
                    now, filled, chunk = groups[at], 0.0, 1
                got, filled, chunk = greedy_chunks(sizes[at:end], filled, chunk, limit)
                numbers.append(got)
                at = end
            yield pdf.drop(columns=["_group", "_size"]).assign(chunk=pd.Series(np.concatenate(numbers), index=pdf.index, dtype="int64"))

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", chunk long"
    return spread.mapInPandas(run, schema)


def write_fasta_chunks(df: DataFrame, path: str, order: str, chunk_mb: float = 10, group: str | None = None) -> None:
    """FASTA text partitioned by chunk number; an empty table writes no chunk."""
    numbered = chunk_numbers(df, order, chunk_mb, group).select("chunk", fasta_text().alias("value"))
    numbered.write.mode("overwrite").partitionBy("chunk").text(path)


def stream_fasta(spark: SparkSession, directory: str) -> DataFrame:
    """Records of files that arrive in a folder, as a stream."""
    raw = spark.readStream.option("lineSep", "\n>").text(directory).select("value", F.col("_metadata.file_path").alias("source_file"))
    return parse_records(raw)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Iterable", "Iterator", "Path", "Window", "np", "pa", "re")]
