"""Recovery of fields from model replies: plain, fenced, wrapped in prose or cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLY = "struct<suspicion_score:double,suspected_failure:string,confidence:double,explanation:string>"
EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "mpg", "mpeg", "wmv", "flv", "3gp", "ts", "mts", "ogv", "gif", "webp")


def parse_reply(df):
    """Adds ``suspicion_score, suspected_failure, explanation, confidence, parsed`` for a column ``raw``.

    The outermost braces are parsed as JSON, whose fields count if it is whole. Where it is not, single
    fields are recovered by pattern, numbers also without a leading digit, texts also if the reply ends
    inside them; without a score that gives no signal (null) and says what was not understood. A missing
    confidence is 0. A null reply is an empty one.
    """
    raw = F.coalesce("raw", F.lit(""))
    body = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = df.withColumns({"__j": F.from_json(body, REPLY), "__whole": F.try_parse_json(body).isNotNull()})
    field = lambda name, recovered: F.when(F.col("__whole"), F.col(f"__j.{name}")).otherwise(recovered)
    score = field("suspicion_score", _number("suspicion_score"))
    known = lambda found, default: F.when(score.isNotNull(), F.coalesce(found, default)).otherwise(default)
    none = F.lit(None).cast("string")
    said = F.when(score.isNotNull(), F.coalesce(_text("explanation"), F.lit("recovered from truncated reply"))).otherwise(F.concat(F.lit("unparseable: "), F.substring(raw, 1, 120)))
    return parsed.withColumns({
        "suspicion_score": score,
        "suspected_failure": field("suspected_failure", known(_text("suspected_failure"), none)),
        "explanation": field("explanation", said),
        "confidence": F.coalesce(field("confidence", known(_number("confidence"), F.lit(0.0))), F.lit(0.0)),
        "parsed": score.isNotNull(),
    }).drop("__j", "__whole")


#: Where a reply's text may stand, in this order.
TEXT_KEYS = ("response", "answer", "output", "text", "result", "content")


def reply_text(raw: Column) -> Column:
    """The first text that isn't blank under ``TEXT_KEYS`` of a JSON object, looked for in the order of the
    keys, inside an object before the next key; empty if there is none.

    A walk over a stack of values: every step takes the first off and, if it is an object, puts its six
    fields in its place. A reply has at most as many values as colons, so that many steps are enough.
    """
    kind = "struct<stack:array<variant>,found:string>"

    def step(a: Column, _: Column) -> Column:
        head, rest = F.get(a["stack"], F.lit(0)), F.slice(a["stack"], F.lit(2), F.greatest(F.size(a["stack"]) - 1, F.lit(0)))
        of = F.schema_of_variant(head)
        inner = F.filter(F.array(*[F.try_variant_get(head, f"$.{k}", "variant") for k in TEXT_KEYS]), lambda v: v.isNotNull())
        text = F.try_variant_get(head, "$", "string")
        done = a["found"].isNotNull() | (F.size(a["stack"]) == 0)
        is_text = (of == "STRING") & text.rlike(r"\S")
        stack = F.when(done, a["stack"]).when(of.startswith("OBJECT"), F.concat(inner, rest)).otherwise(rest)
        return F.struct(stack.alias("stack"), F.when(done, a["found"]).when(is_text, text).alias("found")).cast(kind)

    top = F.try_parse_json(raw)
    start = F.struct(F.when(F.schema_of_variant(top).startswith("OBJECT"), F.array(top)).otherwise(F.array().cast("array<variant>")).alias("stack"), F.lit(None).cast("string").alias("found")).cast(kind)
    steps = F.sequence(F.lit(1), F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(":")) + 1)
    return F.coalesce(F.aggregate(steps, start, step, lambda a: a["found"]), F.lit(""))


def _number(name: str) -> Column:
    return F.regexp_extract("raw", rf'"{name}"\s*:\s*(-?[0-9]*[.]?[0-9]+)', 1).try_cast("double")


def _text(name: str) -> Column:
    empty = F.lit("")
    whole = F.nullif(F.regexp_extract("raw", rf'"{name}"\s*:\s*"([^"]*)"', 1), empty)
    return F.coalesce(whole, F.nullif(F.trim(F.regexp_extract("raw", rf'"{name}"\s*:\s*"([^"]+)$', 1)), empty))


SIGNAL = "struct<frame:double,t:double,signal_type:string,score:double>"
ENVELOPE = f"struct<source:string,fps:double,severity:double,signals:array<{SIGNAL}>>"


def signal_payload(df, fps: float, frames: int):
    """``source, t, frame, signal_type, score, severity`` of every signal of the JSON in ``raw``: a list of
    signals, a list of envelopes, or a map from source to envelope. Signals without a place are left out."""
    bare = F.struct(F.lit(None).cast("string").alias("source"), F.lit(fps).alias("fps"), F.lit(None).cast("double").alias("severity"), F.from_json("raw", f"array<{SIGNAL}>").alias("signals"))
    named = F.transform(F.map_entries(F.from_json("raw", f"map<string,{ENVELOPE}>")), lambda e: F.struct(F.coalesce(e["value"]["source"], e["key"]).alias("source"), e["value"]["fps"].alias("fps"), e["value"]["severity"].alias("severity"), e["value"]["signals"].alias("signals")))
    is_map, has_signals = F.startswith(F.ltrim("raw"), F.lit("{")), F.contains("raw", F.lit('"signals"'))
    envelopes = F.when(is_map, named).when(has_signals, F.from_json("raw", f"array<{ENVELOPE}>")).otherwise(F.array(bare))
    each = df.withColumn("__e", F.explode(envelopes)).select("*", F.explode("__e.signals").alias("__s")).where("__s.t IS NOT NULL OR __s.frame IS NOT NULL")
    t = F.coalesce("__s.t", F.col("__s.frame") / F.greatest(F.coalesce("__e.fps", F.lit(fps)), F.lit(1e-6)))
    frame = F.greatest(F.lit(0), F.least(F.bround(F.round(t * fps, 6)).cast("long"), F.lit(frames - 1)))
    return each.select(
        *[c for c in df.columns if c != "raw"], F.coalesce("__e.source", F.lit("Stage 1 test")).alias("source"), F.round(t, 9).alias("t"), frame.cast("long").alias("frame"),
        F.coalesce("__s.signal_type", F.lit("anomaly")).alias("signal_type"), F.coalesce("__s.score", F.lit(1.0)).alias("score"), F.col("__e.severity").alias("severity"),
    )


def sanitised_plan(raw: Column, tools: list[str], most: int) -> Column:
    """The known tools that a reply's ``run`` names, in the order of ``tools``; empty if it says that
    there is enough, null if it has no list."""
    said = F.from_json(raw, "struct<sufficient:boolean,run:array<string>>")
    known = F.slice(F.filter(F.array(*map(F.lit, tools)), lambda x: F.array_contains(said["run"], x)), 1, most)
    return F.when(said["sufficient"], F.array().cast("array<string>")).when(said["run"].isNotNull(), known)


def percent(c: Column) -> Column:
    """A number that may be written with a percent sign."""
    return F.replace(F.trim(c), F.lit("%"), F.lit("")).try_cast("double")


def allowed_extension(path: Column, allowed: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*allowed)


def fingerprint(data: Column, part: int = 1 << 20) -> Column:
    """16 hex digits of SHA-1 over size, first and last MiB of a binary column (last only if larger)."""
    n = F.octet_length(data)
    tail = F.when(n > part, F.substring(data, n - part + 1, F.lit(part))).otherwise(F.lit(b""))
    return F.substring(F.sha1(F.concat(F.encode(n.cast("string"), "UTF-8"), F.substring(data, F.lit(1), F.lit(part)), tail)), 1, 16)
