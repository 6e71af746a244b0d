"""Which producers must run before an operator can judge a video, and running them for all videos at once.

Modes: ``off`` runs nothing; ``rules`` runs the producers an operator needs and a video lacks, dependencies
first; ``agent`` lets a model say so for each video, and falls back on the rules where its reply is missing or
of no use. Model and producers are the caller's: functions from tables to tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.parsing import sanitised_plan
from tracewright.operators.evidence_table import EvidenceTable
from tracewright.sources.scratch import written

#: Producers in the order of their dependencies, what they give and what they cost.
TOOLS = {
    "object_tracker": ("tracks of objects", "medium"),
    "trajectory_extractor": ("trajectories and contacts", "medium"),
    "event_localizer": ("windows of suspected events", "cheap"),
    "physics_hypothesis_generator": ("ranked hypotheses", "medium"),
}
MODES = ("off", "rules", "agent")
#: From ``video_id, prompt`` to ``video_id, raw``.
Ask = Callable[[DataFrame], DataFrame]
#: From ``video_id`` of the videos to run for to ``video_id, payload``.
Runner = Callable[[DataFrame], DataFrame]


def _in_order(names) -> F.Column:
    return F.filter(F.array(*map(F.lit, TOOLS)), names)


def planned(videos: DataFrame, held: DataFrame, needs: list[str], mode: str = "rules", replies: DataFrame | None = None, most: int = 3) -> DataFrame:
    """``video_id, run, how``: the producers to run for each video, in order.

    ``held`` has ``video_id, stage_id`` of what there is. ``replies`` (``video_id, raw``) count in mode
    ``agent``: one that says there is enough runs nothing (``sufficient``), one with a list runs the known
    producers in it, ``most`` at most (``told``), any other and a missing one leave it to the rules
    (``fallback``). Repeated videos are one, of several replies for one the last in byte order counts.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    if unknown := set(needs) - set(TOOLS):
        raise ValueError(f"no producer {', '.join(sorted(unknown))}")
    v = videos.select("video_id").where("video_id IS NOT NULL").distinct()
    if mode == "off":
        return v.select("video_id", F.array().cast("array<string>").alias("run"), F.lit("off").alias("how"))
    have = held.groupBy("video_id").agg(F.collect_set(F.when(F.col("stage_id").isin(*TOOLS), F.col("stage_id"))).alias("have"))
    v = v.join(have, "video_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    rules = _in_order(lambda t: F.array_contains(F.array(*map(F.lit, needs)) if needs else F.array().cast("array<string>"), t) & ~F.array_contains("have", t))
    if mode == "rules":
        return v.select("video_id", rules.alias("run"), F.lit("rules").alias("how"))
    if replies is None:
        replies = v.select("video_id", F.lit(None).cast("string").alias("raw"))
    said = replies.groupBy("video_id").agg(F.max("raw").alias("raw"))
    v = v.join(said, "video_id", "left").withColumn("told", sanitised_plan(F.col("raw"), list(TOOLS), most))
    how = F.when(F.col("told").isNull(), "fallback").when(F.size("told") == 0, "sufficient").otherwise("told")
    return v.select("video_id", F.coalesce("told", rules).alias("run"), how.alias("how"))


def prompts(videos: DataFrame, held: DataFrame, needs: list[str], wanted: str = "physical evidence") -> DataFrame:
    """``video_id, prompt``: what a model is asked about each video: what is needed, what there is, what may run."""
    menu = "; ".join(f"{name}: gives {gives}, {cost}" for name, (gives, cost) in TOOLS.items())
    have = held.where(F.col("stage_id").isin(*TOOLS)).groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_set("stage_id")), ", ").alias("have"))
    v = videos.select("video_id").distinct().join(have, "video_id", "left")
    ask = F.format_string(
        'A check of %s needs: %s. Evidence of this video: %s. Producers: %s. Answer in JSON: {"sufficient": true or false, "run": [at most three producers]}.',
        F.lit(wanted), F.lit(", ".join(needs) or "nothing"), F.coalesce("have", F.lit("none")), F.lit(menu),
    )
    return v.select("video_id", ask.alias("prompt"))


def ensure(store: EvidenceTable, videos: DataFrame, needs: list[str], runners: dict[str, Runner], mode: str = "rules", ask: Ask | None = None) -> list[dict]:
    """Run what ``videos`` lack and put it into the store; log events of what was done.

    A producer runs once, for all the videos whose plan names it, after those it depends on. One that fails or is
    not there is logged and stops no other. A model that fails leaves all to the rules.
    """
    events: list[dict] = []

    def log(level: str, text: str) -> None:
        events.append({"type": "log", "level": level, "text": text})

    held, replies = store.get_all(), None
    if mode == "agent" and ask is None:
        log("warn", "no model to ask: rules")
    elif mode == "agent":
        try:
            replies = ask(prompts(videos, held, needs)).select(F.col("video_id").cast("string").alias("video_id"), F.col("raw").cast("string").alias("raw"))
            replies = written(replies, "replies")  # a model that fails does so here
        except Exception as e:
            log("warn", f"the model failed ({type(e).__name__}: {e}): rules")
    plan = planned(videos.select(F.col("video_id").cast("string").alias("video_id")), held, needs, mode, replies)
    steps = plan.select("video_id", F.explode("run").alias("stage_id"))
    counts = {r.stage_id: r.n for r in steps.groupBy("stage_id").agg(F.count("*").alias("n")).collect()}  # a row a producer
    if not counts:
        log("info", "nothing to run")
        return events
    lacking = written(steps, "plan")  # what is put while it is carried out doesn't change it
    gained = []
    for name in (t for t in TOOLS if t in counts):
        log("info", f"{name} for {counts[name]} videos ({TOOLS[name][1]})")
        try:
            made = runners[name](lacking.where(F.col("stage_id") == name).select("video_id"))
            store.put(made.select("video_id", F.lit(name).alias("stage_id"), "payload"))
            gained.append(name)
        except Exception as e:
            log("warn", f"{name} failed ({type(e).__name__}: {e}): going on with what there is")
    got = store.has(lacking).where("has").count()
    log("success" if got else "warn", f"{got} of {sum(counts.values())} gained" + (f" by {', '.join(gained)}" if gained else ""))
    return events
