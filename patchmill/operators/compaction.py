"""Too many small files: a plan of well-sized files over a listing, and byte-level concatenation that carries it out."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchmill.errors import DataError
from patchmill.functions.labels import path_plain
from patchmill.storage import Workspace, running_sums

# Endings of data files, first bytes of a zstandard frame and of a skippable one.
DATA_ENDINGS = "jpg|jpeg|png|webp|tif|bmp|tar"
ZSTD_MAGIC = bytes.fromhex("28b52ffd")
MB128 = 134_217_728


def data_files(listing: DataFrame) -> DataFrame:
    """(file, dir, name, length): each data file once.

    Directory and file are those of path with single forward slashes, without ``.`` components and blanks at the ends; a path listed
    more than once is one file with its greatest length. Files without a length above 0, with a name that begins with ``.`` or ``_``
    or without a data ending are no data files; NULL paths are none either.
    """
    x = listing.where("length > 0").select(path_plain("path").alias("file"), "length")
    x = x.groupBy("file").agg(F.max("length").alias("length"))
    x = x.select("file", F.regexp_replace("file", "/?[^/]*$", "").alias("dir"), F.substring_index("file", "/", -1).alias("name"), "length")
    return x.where(F.col("name").rlike(f"(?i)^[^._].*(?:{DATA_ENDINGS})$") | F.col("name").rlike(f"(?i)^(?:{DATA_ENDINGS})$"))


def laid_out(files: DataFrame, grp: str, target: int = MB128, *, window_bytes: int = 8 << 20) -> DataFrame:
    """files with before, nth and cell: the bytes and files that lie before each in its group, in the order of names, and the output's number that it begins in.

    Running sums in two levels: a group of any number of files is spread over ranges of names, so no task ever holds a hot directory.
    """
    x = files.withColumn("_one", F.lit(1).cast("long"))
    x = running_sums(x, [grp], F.col("file").asc(), {"_end": "length", "nth": "_one"}, window_bytes=window_bytes)
    return x.withColumn("before", F.col("_end") - F.col("length")).withColumn("cell", F.floor(F.col("before") / target)).drop("_end", "_one")


def directory_report(files: DataFrame, target: int = MB128, factor: int = 8) -> DataFrame:
    """(dir, n_files, bytes, due_files, too_many): each directory's files against the outputs that laying them end to end takes."""
    x = laid_out(files, "dir", target)
    d = x.groupBy("dir").agg(F.max("nth").alias("n_files"), F.max(F.col("before") + F.col("length")).alias("bytes"))
    d = d.withColumn("due_files", F.ceil(F.col("bytes") / target))
    return d.withColumn("too_many", F.col("n_files") >= factor * F.col("due_files"))


def compaction_plan(files: DataFrame, directories: DataFrame, target: int = MB128, *, small_dirs_by: int = 3) -> DataFrame:
    """(file, length, output, seq, offset): the output file and place in it of each file of a directory with too many.

    Files of a directory that fills an output go together; smaller directories are put together by their first ``small_dirs_by``
    components. The files of each such group are laid end to end in the order of their names and cut where the target is reached, so
    outputs are of the target's size however small the files are; a file larger than the target is the last of its output. Every
    file of the directories taken is in exactly one output.
    """
    d = directories.where("too_many")
    head = F.array_join(F.slice(F.split("dir", "/"), 1, small_dirs_by + 1), "/")
    d = d.select("dir", F.when(F.col("bytes") >= target, F.col("dir")).otherwise(F.concat(head, F.lit("/*"))).alias("grp"))
    ws = Workspace(files.sparkSession, "layout")
    x = ws.cut(laid_out(files.join(d, "dir").select("grp", "file", "length"), "grp", target))
    first = x.groupBy("grp", "cell").agg(F.min("before").alias("_b"), F.min("nth").alias("_n"))
    x = x.join(first, ["grp", "cell"])
    output = F.concat(F.regexp_replace("grp", r"/\*$", ""), F.lit("/compact-"), F.substring(F.md5("grp"), 1, 6), F.format_string("-%08d", F.col("cell")))
    return x.select("file", "length", output.alias("output"), (F.col("nth") - F.col("_n") + 1).alias("seq"), (F.col("before") - F.col("_b")).alias("offset"))


def manifest_plan(items: DataFrame, listing: DataFrame, target: int = MB128) -> DataFrame:
    """(file, role, length, output, seq, offset, status): every img and mask of items exactly once, with its place in an output file.

    status: ``placed``; ``empty``, a listed file of length 0, whose place has length 0; ``unknown length``, a listed file without a
    length; ``unlisted``. The last two have NULL places: they are reported, not dropped. A file counts by what items say it is, not by its name's ending. A file that is img and mask of several items is
    planned once, with the role ``img``.
    """
    ws = Workspace(items.sparkSession, "compaction")
    own = items.select(F.explode(F.array(F.struct(path_plain("img").alias("file"), F.lit("img").alias("role")), F.struct(path_plain("mask").alias("file"), F.lit("mask").alias("role")))).alias("f")).select("f.*")
    own = own.where("file is not null and file <> ''").groupBy("file").agg(F.min("role").alias("role"))
    files = listing.select(path_plain("path").alias("file"), "length").groupBy("file").agg(F.max("length").alias("length"))
    files = ws.cut(files.join(own, "file", "left_semi").withColumn("dir", F.regexp_replace("file", "/?[^/]*$", "")))
    wanted = files.where("length >= 0")
    dirs = wanted.groupBy("dir").agg(F.sum("length").alias("bytes")).withColumn("too_many", F.lit(True))
    status = F.when(F.col("length") > 0, "placed").when(F.col("length") == 0, "empty").otherwise("unknown length").alias("status")
    plan = own.join(compaction_plan(wanted, dirs, target), "file", "left").join(files.select("file", status), "file", "left")
    return plan.na.fill("unlisted", ["status"])


WRITTEN = "output string, n_files long, bytes long, crc32 long, sha256 string"


def concatenate(plan: DataFrame, out_dir: str, kind: str = "blob", *, header: bool = False, chunk: int = 1 << 20, most_files: int = 20_000) -> DataFrame:
    """Carry out a plan: (output, n_files, bytes, crc32, sha256) of each file written under out_dir, bytes copied as they are.

    kind: ``blob`` joins files end to end (the plan's offsets are the index); ``lines`` joins newline-delimited files, adding a missing
    last newline, and with header keeps the first file's first line only, which all files must share; ``zstd`` joins complete
    zstandard frames, whose bytes are checked to begin and end as frames do without being decompressed. Lengths are checked
    against the plan, the file written is read again against its checksum, and it gets its name by a move at the very end, so that a
    task that runs twice leaves one whole file. Paths are local ones that all executors reach or URIs of a file system that Arrow
    knows (file, hdfs, s3, gs). A task opens ``most_files`` files at most: an output of more is written in parts first, which are
    joined and deleted.
    """
    if kind not in ("blob", "lines", "zstd"):
        raise ValueError(f"unknown kind {kind!r}")
    cols = plan.where("output is not null").select("output", "seq", "file", "length")
    part = F.floor((F.col("seq") - 1) / most_files).cast("long")
    small = cols.groupBy("output").agg(F.max(part).alias("parts"), F.count("*").alias("n"))
    cols = cols.join(small, "output").withColumn("part", F.when(F.col("parts") > 0, part).otherwise(F.lit(-1).cast("long")))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name = key[0] if key[1] < 0 else f"{key[0]}.part-{key[1]:05d}"
        out = _write(list(pdf.sort_values("seq")[["file", "length"]].itertuples(index=False, name=None)), name, out_dir, kind, header, chunk)
        return pd.DataFrame([(key[0], key[1], *out)], columns=["output", "part", "path", "n_files", "bytes", "crc32", "sha256"])

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        path, _, n, crc, sha = _write(list(pdf[["path", "bytes"]].itertuples(index=False, name=None)), pdf["output"].iloc[0], out_dir, kind, header, chunk)
        for p in pdf["path"]:
            _delete(p)
        return pd.DataFrame([(path, int(pdf["n_files"].sum()), n, crc, sha)], columns=["output", "n_files", "bytes", "crc32", "sha256"])

    done = Workspace(plan.sparkSession, "written").cut(cols.groupBy("output", "part").applyInPandas(first, "output string, part long, path string, n_files long, bytes long, crc32 long, sha256 string"))
    whole = done.where("part < 0").select(F.col("path").alias("output"), "n_files", "bytes", "crc32", "sha256")
    if done.where("part >= 0").isEmpty():
        return whole
    return Workspace(plan.sparkSession, "written").cut(whole.unionByName(done.where("part >= 0").groupBy("output").applyInPandas(second, WRITTEN)))


def _place(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _delete(path: str) -> None:
    f, at = _place(path)
    f.delete_file(at)


def _write(files: list[tuple[str, int]], output: str, out_dir: str, kind: str, header: bool, chunk: int) -> tuple:
    import uuid

    to = f"{out_dir.rstrip('/')}/{output.strip('/')}"
    f, at = _place(to)
    f.create_dir(at.rsplit("/", 1)[0], recursive=True)
    tmp = f"{at}.{uuid.uuid4().hex}.part"
    crc, sha, n, first_line = 0, hashlib.sha256(), 0, None
    with f.open_output_stream(tmp) as w:

        def put(b: bytes) -> None:
            nonlocal crc, n
            w.write(b)
            crc = zlib.crc32(b, crc)
            sha.update(b)
            n += len(b)

        for path, length in files:
            g, source = _place(path)
            with g.open_input_file(source) as r:
                if r.size() != length:
                    raise DataError(f"{path} has {r.size()} bytes, the plan says {length}")
                if kind == "zstd":
                    _check_frames(r, length, path)
                    r.seek(0)
                b = r.read(chunk)
                if header and kind == "lines":
                    while b"\n" not in b and (more := r.read(chunk)):
                        b += more
                    line, _, b = b.partition(b"\n")
                    if first_line is None:
                        first_line = line.rstrip(b"\r")
                        put(first_line + b"\n")
                    elif line.rstrip(b"\r") != first_line:
                        raise DataError(f"{path} has another header")
                    b = b or r.read(chunk)
                last = b"\n"
                while b:
                    put(b)
                    last = b[-1:]
                    b = r.read(chunk)
                if kind == "lines" and last != b"\n":
                    put(b"\n")
    again, m = hashlib.sha256(), 0
    with f.open_input_stream(tmp) as r:
        while b := r.read(chunk):
            again.update(b)
            m += len(b)
    if again.digest() != sha.digest() or m != n:
        raise DataError(f"{output} was not written as read")
    f.move(tmp, at)
    return to, len(files), n, crc, sha.hexdigest()


def _check_frames(f, length: int, path: str) -> None:
    """Walk the blocks of a file's zstandard frames by their headers; they must end exactly at the file's end."""
    at = 0
    while at < length:
        f.seek(at)
        head = f.read(18)
        if head[:4] != ZSTD_MAGIC:
            if len(head) >= 8 and head[1:4] == b"\x2a\x4d\x18" and 0x50 <= head[0] <= 0x5F:
                at += 8 + int.from_bytes(head[4:8], "little")
                continue
            raise DataError(f"{path}: no zstandard frame at byte {at}")
        d = head[4]
        single, checksum = d >> 5 & 1, d >> 2 & 1
        at += 5 + (1 - single) + (0, 1, 2, 4)[d & 3] + ((1 if single else 0), 2, 4, 8)[d >> 6]
        last = 0
        while not last:
            f.seek(at)
            b = f.read(3)
            if len(b) < 3:
                raise DataError(f"{path}: a frame breaks off at byte {at}")
            h = int.from_bytes(b, "little")
            last, kind, size = h & 1, h >> 1 & 3, h >> 3
            if kind == 3:
                raise DataError(f"{path}: a bad block at byte {at}")
            at += 3 + (1 if kind == 1 else size)
        at += 4 * checksum
    if at != length:
        raise DataError(f"{path}: its last frame ends at byte {at} of {length}")
