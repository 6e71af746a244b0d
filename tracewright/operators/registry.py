"""Operators by name with typed, clamped settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Setting:
    id: str
    type: str
    default: float | int | bool | str
    low: float | None = None
    high: float | None = None
    label: str = ""
    #: The values that a ``str`` setting may have (none: any); the default stands for all others.
    options: tuple[str, ...] = ()

    def read(self, value):
        """``value`` as this setting's type, within its bounds; the default for null or nonsense."""
        if value is None:
            return self.default
        try:
            if self.type == "bool":
                return value if isinstance(value, bool) else str(value).strip().lower() not in ("false", "0", "no", "")
            if self.type == "str":
                return str(value) if not self.options or str(value) in self.options else self.default
            v = int(float(value)) if self.type == "int" else float(value)
        except (TypeError, ValueError):
            return self.default
        v = v if self.low is None else max(v, self.low)
        return v if self.high is None else min(v, self.high)


@dataclass(frozen=True)
class Operator:
    id: str
    stage: int
    query: str
    settings: tuple[Setting, ...] = field(default_factory=tuple)
    #: Canonical tables that it reads.
    reads: tuple[str, ...] = ()

    @property
    def tier(self) -> str:
        """What a run costs: screening is cheap, specialists read whole tracks, a report only aggregates."""
        return {1: "cheap", 2: "medium", 3: "medium", 4: "output"}[self.stage]

    def configure(self, given: dict | None = None) -> dict:
        given = given or {}
        return {s.id: s.read(given.get(s.id)) for s in self.settings}

    def run(self, spark, source, given: dict | None = None):
        """The operator's rows under the given settings; unknown ones are an error. ``source`` is a folder of
        driver tables, or ``Bound`` tables of the user's own (see ``reads``): the query is the same."""
        from tracewright.plans import catalog

        if unknown := set(given or {}) - {s.id for s in self.settings}:
            raise KeyError(f"{self.id} has no setting {', '.join(sorted(unknown))}")
        return catalog.QUERIES[self.query](spark, source, **self.configure(given))


OBSERVED, SIGNALLED, ANSWERED, TESTED, DESCRIBED = ("observations",), ("signals",), ("observations", "answers"), ("tests",), ("descriptors",)
OPERATORS = [
    Operator("temporal_smoothness", 1, "acceleration_frames", (Setting("threshold", "float", 40.0, 0.001, 1e6, "Acceleration threshold"),), OBSERVED),
    Operator("optical_flow", 1, "flow_signals", (Setting("spike", "float", 60.0, 0.001, 1e6, "Flow spike threshold"), Setting("floor", "float", 0.35, 0, 1, "Direction consistency floor (0-1)")), OBSERVED),
    Operator("camera_motion", 1, "inlier_gate", (Setting("min_inliers", "float", 0.75, 0, 1, "Least ratio of inliers"),), OBSERVED),
    Operator("embedding_biomarkers", 1, "latent_accel_flags", (Setting("threshold", "float", 2.4, 0, 10, "Latent acceleration threshold"),), DESCRIBED),
    Operator("trajectory_extractor", 2, "self_motion_signals", (Setting("z_threshold", "float", 3.5, 1, 10, "Robust z-score of a spike"),), OBSERVED),
    Operator("object_tracker", 2, "contact_rising_edges", (Setting("near_px", "float", 6.0, 0, 100, "Distance that counts as a contact"),), OBSERVED),
    Operator("event_localizer", 2, "event_markers", (Setting("merge_frames", "int", 30, 1, 600, "Frames between signals of one event"),), SIGNALLED),
    Operator("physics_hypothesis_generator", 2, "hypothesis_merge", (Setting("top", "int", 3, 1, 7, "Hypotheses kept of a video"),), ("signals", "observations")),
    Operator("gravity", 3, "free_flight_checks", (Setting("r2_min", "float", 0.6, 0, 1, "Least fit of a parabola"),), OBSERVED),
    Operator("collision", 3, "restitution", (Setting("restitution_max", "float", 1.1, 0.5, 3, "Largest ratio of speeds after and before"),), OBSERVED),
    Operator("momentum", 3, "momentum_jump", (Setting("tolerance", "float", 0.6, 0.1, 5, "Jump of speed that needs a contact"),), OBSERVED),
    Operator("friction", 3, "no_friction", (Setting("tolerance", "float", 0.1, 0.01, 1, "Slope under which nothing slows down"),), OBSERVED),
    Operator("fluid", 3, "flow_discontinuity", (Setting("tolerance", "float", 2.0, 0.1, 20, "Jump of the flow"),), OBSERVED),
    Operator("deformation", 3, "change_points", (Setting("spike", "float", 1.25, 0, 2, "Distance of a change"),), DESCRIBED),
    Operator("causality", 3, "causality_severity", (Setting("fire_threshold", "float", 0.5, 0, 1, "Probability from which a rule fires"),), ANSWERED),
    Operator("diagnostic_report", 4, "findings_timeline", (), ("signals", "observations")),
]


def find(name: str) -> Operator:
    for o in OPERATORS:
        if o.id == name:
            return o
    raise KeyError(f"no operator {name!r}; there are {', '.join(o.id for o in OPERATORS)}")
