"""Selective reads of multistream bzip2 dumps: only the streams at chosen byte offsets are opened.

A task gets a run of offsets. It seeks to each and decompresses one stream there; nothing else of
the file is read. Paths without a scheme must be visible to every executor; those with one
(hdfs, s3) go through Arrow's filesystems.
"""

from __future__ import annotations

import bz2
import os
import shutil
import sys
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.sources.shared import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHUNK = 1 << 18
#: Streams that a task opens, at about.
TASK_STREAMS = 16


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _place(path: str) -> tuple:
    """(filesystem, path in it) of a path with a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _create(path: str):
    if "://" in path:
        system, inner = _place(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, "wb")


def _copy(source: str, out) -> None:
    with _open(source) as raw:
        while chunk := raw.read(_CHUNK):
            out.write(chunk)


def _finish(begun: str, path: str, parts: str) -> None:
    """Give the whole file its name and remove its parts."""
    if "://" in path:
        system, inner = _place(path)
        system.move(_place(begun)[1], inner)
        system.delete_dir(_place(parts)[1])
    else:
        os.replace(begun, path)
        shutil.rmtree(parts)


def read_stream(path: str, offset: int) -> bytes:
    """The one compressed stream that begins at `offset`, decompressed."""
    machine, out = bz2.BZ2Decompressor(), []
    with _open(path) as raw:
        raw.seek(offset)
        while not machine.eof:
            chunk = raw.read(_CHUNK)
            if not chunk:
                break
            out.append(machine.decompress(chunk))
    return b"".join(out)


def _text(node: ET.Element | None) -> str | None:
    return None if node is None else node.text


def pages_in(fragment: bytes, compat_ids: bool = False) -> Iterator[tuple]:
    """(page_id, title, is_redirect, redirect_to, text) of the pages of a fragment; it ends early where the XML breaks.

    `compat_ids` takes the last id ahead of the text, the contributor's or the revision's, as the page's.
    """
    parser = ET.XMLPullParser(["start", "end"])
    start = fragment.find(b"<page")
    if start < 0:
        return
    parser.feed(b"<fragment>")
    try:
        parser.feed(fragment[start:])
    except ET.ParseError:
        pass
    events = parser.read_events()
    while True:
        try:
            kind, node = next(events)
        except (StopIteration, ET.ParseError):  # what came before the error is given out
            return
        if kind == "end" and node.tag == "page":
            redirect, page_id = node.find("redirect"), _text(node.find("id"))
            if compat_ids:
                page_id = _text(node.find("revision/contributor/id")) or _text(node.find("revision/id")) or page_id
            text = _text(node.find("revision/text"))
            yield (
                int(page_id) if page_id and page_id.strip().isdigit() else None,
                _text(node.find("title")),
                redirect is not None,
                None if redirect is None else redirect.get("title"),
                text or None,
            )


def _spread(offsets: DataFrame) -> DataFrame:
    """Distinct offsets in runs that follow the file, so that a task reads forward."""
    wanted = offsets.select(F.col("offset").cast("bigint").alias("offset")).where("offset is not null").distinct()
    # offsets are small and their streams aren't: left to itself, Spark would put them all into one task
    return wanted.repartitionByRange(max(1, -(-wanted.count() // TASK_STREAMS)), "offset").sortWithinPartitions("offset")


def read_pages_at(path: str, offsets: DataFrame, compat_ids: bool = False) -> DataFrame:
    """(offset, page_id, title, is_redirect, redirect_to, text) of the pages in the streams at `offsets`.

    `offsets` has a column `offset`; null and repeated ones count for nothing. `compat_ids` is that of
    :func:`tomeforge.sources.dumps.pages_of`.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for offset in batch.column("offset").to_pylist():
                rows = [(offset, *page) for page in pages_in(read_stream(path, offset), compat_ids)]
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["offset", "page_id", "title", "is_redirect", "redirect_to", "text"])

    return _spread(offsets).mapInArrow(run, "offset long, page_id long, title string, is_redirect boolean, redirect_to string, text string")


def read_streams_at(path: str, offsets: DataFrame) -> DataFrame:
    """(offset, content): the decompressed streams at `offsets` as text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for offset in batch.column("offset").to_pylist():
                content = read_stream(path, offset).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([offset], pa.int64()), pa.array([content], pa.string())], names=["offset", "content"])

    return _spread(offsets).mapInArrow(run, "offset long, content string")


def one_stream(spark: SparkSession, path: str, index: DataFrame, n: int) -> DataFrame:
    """(offset, content) of the stream with the n-th smallest offset, from 0; no row if there are fewer."""
    from tomeforge.sources.indices import nth_offset

    offset = nth_offset(index, n)
    wanted = spark.createDataFrame([] if offset is None else [(offset,)], "offset long")
    return read_streams_at(path, wanted)


def lines_of(streams: DataFrame) -> DataFrame:
    """(offset, line_no, line) of stream contents, without line ends."""
    # without the last line's end no empty line follows it; the array is exploded in place and not kept
    whole = streams.where("content <> ''").select("offset", F.regexp_replace("content", r"\r?\n\z", "").alias("content"))
    return whole.select("offset", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))


_WRITTEN = "stream long, file string, at long, length long, lines array<string>, rank long, value string"


def _compressed(values: list[str]) -> bytes:
    return bz2.compress("\n".join([*values, ""]).encode())


def _streams_of(folder: str, size: int, base: dict[int, int], total: int):
    """Whole streams of a part go to a file, and a row tells of each; pages of a stream that other parts share are handed on."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("stream", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("lines", pa.list_(pa.string())), ("rank", pa.int64()), ("value", pa.string())])
        held, out, part, rank, name, at = [], None, None, 0, None, 0

        def told():
            """Rows of the pages held, which end a stream or a part."""
            nonlocal at, out, name
            first = rank - len(held)
            stream = first // size
            if first % size == 0 and (len(held) == size or rank == total):
                if out is None:  # a task that is run again writes another file
                    name, at = f"{folder}/{uuid.uuid4().hex}", 0
                    out = _create(name)
                data = _compressed([v for _, v in held])
                out.write(data)
                rows = [{"stream": stream, "file": name, "at": at, "length": len(data), "lines": [line for line, _ in held]}]
                at += len(data)
            else:
                rows = [{"stream": stream, "lines": [line], "rank": first + i, "value": v} for i, (line, v) in enumerate(held)]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema)

        def close():
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in batches:
            for own, i, title, value in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "title", "value"))):
                if own != part:
                    if held:
                        yield told()
                    close()
                    part, rank = own, base[own]
                held.append((f"{i}:{title or ''}", value))
                rank += 1
                if rank % size == 0:
                    yield told()
        if held:
            yield told()
        close()

    return run


def _shared_stream(folder: str):
    """One stream whose pages came from several parts, to a file of its own."""

    def run(pages):
        import pyarrow as pa

        rows = pages.sort_by("rank")
        data, name = _compressed(rows.column("value").to_pylist()), f"{folder}/{uuid.uuid4().hex}"
        with _create(name) as out:
            out.write(data)
        lines = [line for own in rows.column("lines").to_pylist() for line in own]
        return pa.table({"stream": rows.column("stream").slice(0, 1), "file": [name], "at": [0], "length": [len(data)], "lines": pa.array([lines], pa.list_(pa.string()))})

    return run


def write_streams(pages: DataFrame, path: str, size: int = 100, part_pages: int = 10_000) -> DataFrame:
    """Write one multistream dump of `size` pages a stream, by page id; its index lines (value) come back.

    `pages` has `page_id`, `title` and, as from :func:`tomeforge.operators.sinks.dump_xml`, `value`. Tasks
    compress about `part_pages` pages each into files beside the dump; streams that lie across
    parts are put together by themselves. Then all files are copied to their places in the one dump at once,
    and it gets its name when it is whole. Where a path has a scheme, files can't be written in the middle, and
    one task copies the compressed files one after the other. The driver gets a few numbers of each part.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "title", "value")
    total = rows.count()
    wanted = max(1, -(-total // part_pages))
    shares = [k / wanted for k in range(1, wanted)]
    found = rows.agg(F.percentile_approx(F.col("page_id").cast("bigint"), shares, 20 * wanted)).first()[0] if shares else None
    cuts = sorted(set(found or []))

    @F.arrow_udf("int")
    def part_of(ids):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = np.searchsorted(np.array(cuts, np.int64), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), 0, own), pa.int32())  # nulls go first

    dealt = rows.withColumn("part", part_of(F.col("page_id").cast("bigint")))
    base, behind = {}, 0
    for part, n in sorted(map(tuple, rows.select(part_of(F.col("page_id").cast("bigint")).alias("part")).groupBy("part").count().collect())):
        base[part] = behind
        behind += n
    begun = f"{path}.{uuid.uuid4().hex}"
    folder = f"{begun}.parts"
    by_part = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "page_id")
    first = kept(by_part.mapInArrow(_streams_of(folder, size, base, total), _WRITTEN))
    shared = kept(first.where("file is null").groupBy("stream").applyInArrow(_shared_stream(folder), "stream long, file string, at long, length long, lines array<string>"))
    streams = first.where("file is not null").select("stream", "file", "at", "length", "lines").unionByName(shared)
    places, end = [], 0
    for file, _, length in streams.groupBy("file").agg(F.min("stream").alias("stream"), F.sum("length").alias("length")).orderBy("stream").collect():
        places.append((file, end))
        end += length
    with _create(f"{folder}/whole"):  # the folder is there even if no page is
        pass
    with _create(begun) as out:
        if "://" not in path:
            out.truncate(end)

    def copied(batches):
        import pyarrow as pa

        with _create(begun) if "://" in path else open(begun, "r+b") as out:
            for batch in batches:
                for file, place in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                    if "://" not in path:
                        out.seek(place)
                    _copy(file, out)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    placed = spark.createDataFrame(places, "file string, base long")
    if places:
        spread = placed.coalesce(1).sortWithinPartitions("base") if "://" in path else placed.repartition(len(places))
        if sum(r[0] for r in spread.mapInArrow(copied, "n long").collect()) != len(places):
            raise RuntimeError("not all parts of the dump were copied")
    _finish(begun, path, folder)
    lines = streams.join(placed, "file").select((F.col("base") + F.col("at")).alias("at"), F.explode("lines").alias("line"))
    return lines.select(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("line")).alias("value"))


def newline_chunks(size: int, target: int, is_newline_at) -> list[tuple[int, int]]:
    """Byte ranges of about `target` bytes that end behind a newline; all in one if the size is at most twice that.

    `is_newline_at(i)` gives the first newline's position at or behind i, or None.
    """
    if size <= 2 * target:
        return [(0, size)] if size else []
    out, start = [], 0
    while start < size:
        end = is_newline_at(start + target) if start + target < size else None
        end = size if end is None else min(size, end + 1)
        out.append((start, end))
        start = end
    return out
