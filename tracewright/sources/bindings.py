"""A user's own tables in place of a folder of driver tables.

Every plan takes a source: a folder's path, or a ``Bound`` set of named DataFrames. A bound frame is held
against the schema of its name (``external.SCHEMAS``): missing required columns and wrong kinds of types are
errors, missing optional columns are null, further columns are ignored, rows without a place in their table's
order are no observations.

Rules are stated in canonical units: a picture of 100 x 100 and 24 steps a second, a step being the unit
of both ``frame`` and ``t``. ``width``, ``height`` and ``fps`` (with ``t`` in seconds) turn a user's pixels,
seconds and frames into these; without them the columns are taken as canonical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from tracewright.sources.external import SCHEMAS

#: Columns that a bound frame must have and that may not be null in a row that counts.
REQUIRED = {
    "observations": ("video_id", "track_id", "frame", "t", "x", "y"),
    "signals": ("video_id", "signal_type", "frame", "t", "score"),
    "descriptors": ("video_id", "frame", "z"),
    "answers": ("video_id", "event_type", "p"),
    "tests": ("run_id", "stage", "test", "status"),
    "replies": ("raw",),
}
STEPS_A_SECOND, SIZE = 24.0, 100.0


def fits(given: Y.DataType, wanted: Y.DataType) -> bool:
    """Whether values of one type can stand for another: numbers for numbers, anything for text."""
    if isinstance(wanted, Y.StringType):
        return isinstance(given, Y.AtomicType)
    if isinstance(wanted, Y.NumericType):
        return isinstance(given, Y.NumericType)
    if isinstance(wanted, Y.ArrayType):
        return isinstance(given, Y.ArrayType) and fits(given.elementType, wanted.elementType)
    if isinstance(wanted, Y.StructType):
        names = set(given.fieldNames()) if isinstance(given, Y.StructType) else set()
        return all(f.name in names and fits(given[f.name].dataType, f.dataType) for f in wanted)
    return given == wanted


def checked(name: str, df: DataFrame) -> DataFrame:
    """``df`` with the columns and types of the schema ``name``; a ValueError says what doesn't fit."""
    wanted = Y.StructType.fromDDL(SCHEMAS[name])
    have = {f.name: f.dataType for f in df.schema}
    required = REQUIRED.get(name, ())
    wrong = [f"{c} is missing" for c in required if c not in have]
    wrong += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in wanted if f.name in have and not fits(have[f.name], f.dataType)]
    if wrong:
        raise ValueError(f"table {name!r}: " + "; ".join(wrong))
    keys = {"video_id"} & set(have)  # a number stays one: it orders, joins and prints as the user's
    columns = [F.col(f.name) if f.name in keys else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*columns).na.drop(subset=[c for c in required if not isinstance(wanted[c].dataType, (Y.ArrayType, Y.StructType))])


class Derived:
    """A source with views of it that were computed once, under their names; see ``tables.view``."""

    def __init__(self, source, views: dict[str, DataFrame] | None = None) -> None:
        self.source, self.views = source, views or {}


class Bound:
    """Named DataFrames as a source of plans; names that are not canonical are handed out as they are."""

    def __init__(self, frames: dict[str, DataFrame], width: float | None = None, height: float | None = None, fps: float | None = None):
        for what, value in (("width", width), ("height", height), ("fps", fps)):
            if value is not None and not value > 0:
                raise ValueError(f"{what} must be positive, not {value}")
        self.frames = {name: checked(name, df) if name in REQUIRED else df for name, df in frames.items()}
        self.width, self.height, self.fps = width, height, fps

    def __contains__(self, name: str) -> bool:
        return name in self.frames

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            wanted = f" with columns {SCHEMAS[name]}" if name in SCHEMAS else ""
            raise KeyError(f"this needs a table {name!r}{wanted}; bound are {', '.join(sorted(self.frames)) or 'none'}")
        return self.frames[name]

    def _timed(self, df: DataFrame) -> DataFrame:
        """``frame`` and ``t`` in steps."""
        if self.fps is None:
            return df
        return df.withColumns({"frame": F.round(F.col("frame") * (STEPS_A_SECOND / self.fps)).cast("long"), "t": F.col("t") * STEPS_A_SECOND})

    def observations(self) -> DataFrame:
        df = self._timed(self.table("observations"))
        scale = lambda c, size: F.col(c) * (SIZE / size) if size else F.col(c)
        return df.select("video_id", "track_id", "frame", "t", scale("x", self.width).alias("x"), scale("y", self.height).alias("y"), F.col("label").alias("event_type"))

    def signals(self) -> DataFrame:
        return self._timed(self.table("signals")).select("video_id", "track_id", "signal_type", "frame", "t", "score")

    def descriptors(self) -> DataFrame:
        return self.table("descriptors").select(F.col("video_id").alias("clip"), "frame", F.col("z").cast("array<double>").alias("z"))

    def answers(self) -> DataFrame:
        """A model's probability for each kind of event, the largest of several; none if no table is bound."""
        if "answers" not in self:
            video = self.table("observations").schema["video_id"].dataType
            return self.table("observations").sparkSession.createDataFrame([], Y.StructType([Y.StructField("video_id", video), Y.StructField("event_type", Y.StringType()), Y.StructField("p", Y.DoubleType())]))
        return self.table("answers").groupBy("video_id", "event_type").agg(F.max(F.least("p", F.lit(1.0))).alias("p"))
