"""Fetching listed files with a client of the user's, and what a picture's header says of its size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.parsing import EXTENSIONS, allowed_extension

#: Gives a file's bytes for its path; raises where it can't.
Client = Callable[[str], bytes]


def chosen(listing: DataFrame, subfolder: str = "", extensions: tuple[str, ...] = EXTENSIONS, most: int = 0) -> DataFrame:
    """``path, index, total`` of the files to fetch: those with an allowed extension under ``subfolder``, in
    order of path, the first ``most`` (0: all). ``index`` counts from 1.

    The order is told by ranges, so that no task sees all paths: the rows of the ranges before a path's own
    are counted once. Null paths are no files; a path listed twice is fetched once.
    """
    from tracewright.functions.stats import numbered

    folder = subfolder.strip("/")
    paths = listing.select("path").where(allowed_extension(F.col("path"), extensions)).distinct()
    if folder:
        paths = paths.where(F.col("path").startswith(f"{folder}/"))
    if most > 0:
        paths = paths.orderBy("path").limit(most)
    return numbered(paths, ["path"], "index", "total")


def fetched(files: DataFrame, client: Client, parallel: int | None = None, at_once: int = 16) -> DataFrame:
    """``files`` with ``content`` and ``error``: a file that can't be fetched is a row with its error and no
    content, and stops no other. Files are dealt over ``parallel`` tasks (default: as they lie) and go on
    ``at_once`` at a time, so a task holds that many contents."""
    names = [*files.columns, "content", "error"]
    at = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                b = batch.slice(i, at_once)
                contents, errors = [], []
                for path in b.column(at).to_pylist():
                    try:
                        contents.append(client(path))
                        errors.append(None)
                    except Exception as e:  # whatever the client meets is the file's own fault
                        contents.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names)

    dealt = files.repartition(parallel, "path") if parallel else files
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, content binary, error string")


def fetch_events(files: DataFrame) -> DataFrame:
    """What a fetch tells of each of its ``path, index, total, error``: a ``file`` or a ``log`` line saying what
    was skipped, then ``progress``; and ``done`` at the end, by ``place``."""
    ok = F.col("error").isNull()
    null = lambda kind: F.lit(None).cast(kind)
    event = lambda place, kind, text, done: F.struct(place.alias("place"), kind.alias("type"), text.alias("text"), done.alias("done"))
    first = event(2 * F.col("index"), F.when(ok, "file").otherwise("log"), F.when(ok, F.col("path")).otherwise(F.concat(F.lit("Skipped "), "path", F.lit(": "), "error")), null("long"))
    second = event(2 * F.col("index") + 1, F.lit("progress"), null("string"), F.col("index"))
    last = event(2 * F.col("index") + 2, F.lit("done"), null("string"), F.col("total"))
    each = F.when(F.col("index") == F.col("total"), F.array(first, second, last)).otherwise(F.array(first, second))
    return files.select(F.inline(each), "total")


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """``size`` bytes at ``at`` (from 1) as an unsigned number."""
    one = lambda k: F.conv(F.hex(F.substring(content, at + (size - 1 - k if little else k), 1)), 16, 10).cast("long")
    total = one(0)
    for k in range(1, size):
        total = total * 256 + one(k)
    return total


def picture_size(content: Column) -> Column:
    """``width, height`` from the header of a PNG, GIF, BMP or lossy WebP; null for anything else. Nothing
    is decoded, only the first bytes are read."""
    starts = lambda text: F.hex(F.substring(content, 1, len(text) // 2)) == text
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    long_enough = lambda n: F.octet_length(content) >= n
    png = starts("89504E470D0A1A0A") & long_enough(24)
    gif = (starts("474946383761") | starts("474946383961")) & long_enough(10)
    bmp = starts("424D") & long_enough(26)
    webp = starts("52494646") & (F.hex(F.substring(content, 9, 8)) == "5745425056503820") & long_enough(30)
    low = lambda at: _number(content, at, 2, True).bitwiseAND(F.lit(16383))
    return (
        F.when(png, size(_number(content, 17, 4), _number(content, 21, 4)))
        .when(gif, size(_number(content, 7, 2, True), _number(content, 9, 2, True)))
        .when(bmp, size(_number(content, 19, 4, True), _number(content, 23, 4, True)))
        .when(webp, size(low(27), low(29)))
    )


def sized(files: DataFrame) -> DataFrame:
    """``files`` with ``width`` and ``height`` of their ``content``."""
    return files.withColumn("__size", picture_size(F.col("content"))).select("*", "__size.width", "__size.height").drop("__size")
