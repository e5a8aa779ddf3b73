"""A run from a source to its artifacts, one step after the other."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnConfig, InstanceConfig, InstanceNotFound, InvalidRequest, InvalidState, Options, SourceFormat, position_key
from ..operators import convert, infer, issues, profile, quality
from ..operators.headers import canonical_headers
from ..operators.rows import column_counts
from ..operators.sample import first_values
from ..scratch import scratch_path, table
from ..sources import layout as layouts
from ..sources import readers, sinks, store

RULE_CONFIDENCE = 0.5
#: Seconds that profiling and conversion of so many rows are thought to take.
DURATIONS = ((10_000, 5), (100_000, 30), (1_000_000, 180), (10_000_000, 900))
#: Values a column from which types are inferred and that are shown, rows that are shown.
SAMPLE_VALUES, DISPLAY_VALUES, DISPLAY_ROWS = 256, 10, 15
#: From each status the statuses that may follow; any step under way may fail.
FOLLOWS = {
    "PENDING": {"LAYOUT_RESOLVED"}, "LAYOUT_RESOLVED": {"AWAITING_CONFIRMATION"}, "AWAITING_CONFIRMATION": {"CONFIRMED"}, "CONFIRMED": {"PROFILING", "CONFIRMED"}, "PROFILING": {"PROFILED"},
    "PROFILED": {"CONVERTING", "PROFILING"}, "CONVERTING": {quality.READY, quality.WARNINGS, quality.BLOCKED},
}


@dataclass
class Run:
    id: str
    path: str
    status: str = "PENDING"
    layout: SourceFormat | None = None
    names: list[str] = field(default_factory=list)
    suggested: InstanceConfig | None = None
    confirmed: InstanceConfig | None = None
    display: dict[str, Any] = field(default_factory=dict)
    profiles: dict[str, dict[str, Any]] = field(default_factory=dict)
    found: dict[str, list[issues.Issue]] = field(default_factory=dict)
    quality: dict[str, Any] = field(default_factory=dict)
    artifacts: dict[str, str] = field(default_factory=dict)
    failure: str | None = None

    @property
    def issues(self) -> list[issues.Issue]:
        return [i for phase in self.found.values() for i in phase]

    def to(self, status: str) -> None:
        if status not in FOLLOWS.get(self.status, set()):
            raise InvalidState(f"{self.status} is not followed by {status}")
        self.status = status


class MemoryStore:
    """Runs by id, for one process."""

    def __init__(self):
        self.runs: dict[str, Run] = {}

    def save(self, run: Run) -> Run:
        self.runs[run.id] = run
        return run

    def get(self, run_id: str) -> Run:
        if run_id not in self.runs:
            raise InstanceNotFound(run_id)
        return self.runs[run_id]


class FileStore(MemoryStore):
    """Runs as JSON files of a folder in any file system that Spark knows, so that another process finds them after a restart."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, run: Run) -> Run:
        said = asdict(run) | {k: v.to_dict() if (v := getattr(run, k)) else None for k in ("suggested", "confirmed")}
        store.write_text(self.spark, f"{self.folder}/.{run.id}.new", json.dumps(said, sort_keys=True, default=str))
        store.move(self.spark, f"{self.folder}/.{run.id}.new", f"{self.folder}/{run.id}.json")
        return super().save(run)

    def get(self, run_id: str) -> Run:
        if run_id in self.runs:
            return self.runs[run_id]
        path = f"{self.folder}/{run_id}.json"
        if not run_id.isalnum() or not store.exists(self.spark, path):
            raise InstanceNotFound(run_id)
        said = json.loads(store.read_text(self.spark, path))
        for key in ("suggested", "confirmed"):
            said[key] = InstanceConfig.from_dict(said[key]) if said[key] else None
        said["layout"] = SourceFormat(**said["layout"]) if said["layout"] else None
        said["found"] = {phase: [issues.Issue(**i) for i in listed] for phase, listed in said["found"].items()}
        return super().save(Run(**said))


def estimate_seconds(rows: int) -> int:
    """Linear between the known sizes, and beyond the last."""
    (low, a), *rest = DURATIONS
    if rows <= low:
        return a
    for high, b in rest:
        if rows <= high or (high, b) == DURATIONS[-1]:
            return round(a + (b - a) * (rows - low) / (high - low))
        low, a = high, b
    return a


class Engine:
    """Suggest, confirm, profile and convert runs.  Bulk work is DataFrame jobs; the run itself is a small driver object."""

    def __init__(self, spark: SparkSession, store_=None, work_folder: str | None = None):
        self.spark, self.runs = spark, store_ or MemoryStore()
        self.work = work_folder or scratch_path(spark, "runs")

    def suggest(self, path: str, layout: SourceFormat | None = None, codes: bool = False, sample_values: int | None = SAMPLE_VALUES) -> Run:
        """Layout from the prefix, types from the first ``sample_values`` values of each column (None: all), counts from the whole source."""
        return self.type_columns(self.resolve_layout(path, layout).id, codes, sample_values)

    def resolve_layout(self, path: str, layout: SourceFormat | None = None) -> Run:
        """A new run with the layout of its source, as declared and verified or as found in its prefix."""
        run = self.runs.save(Run(uuid.uuid4().hex, path))
        data = store.prefix(self.spark, path)
        kind = layout.kind if layout else {"csv": "csv", "json": "json", "xlsx": "excel"}.get(path.lower().rsplit(".", 1)[-1])
        if kind is None:
            raise InvalidRequest("a source ends in .csv, .json or .xlsx")
        layouts.check_kind(path, kind, data)
        if layout is None:
            layout = layouts.csv_layout(data) if kind == "csv" else SourceFormat(kind) if kind == "json" else self._excel_layout(path)
        layouts.verify(data, layout)
        run.layout = layout
        run.to("LAYOUT_RESOLVED")
        return self.runs.save(run)

    def type_columns(self, run_id: str, codes: bool = False, sample_values: int | None = SAMPLE_VALUES) -> Run:
        """The types of a run whose layout is resolved."""
        run = self.runs.get(run_id)
        if run.status != "LAYOUT_RESOLVED":
            raise InvalidState("columns are typed once the layout is resolved")
        placed = readers.read_source(self.spark, run.path, run.layout, place="__source_row")
        run.names = canonical_headers(placed.columns[:-1])
        placed = placed.toDF(*run.names, "__source_row")
        raw = placed.drop("__source_row")
        cells = table(first_values(placed, max(sample_values or 0, DISPLAY_VALUES), "__source_row"), "sample")
        if sample_values:
            sample = cells.where(F.col("position") <= sample_values)
            tokens = infer.null_tokens_of(sample)
            types = infer.infer_types_of(sample, run.names, tokens, codes)
        else:
            tokens = infer.infer_null_tokens(raw)
            types = infer.infer_types(raw, tokens, codes)
        shown: dict[str, list[str]] = {c: [] for c in run.names}
        for r in cells.where(F.col("position") <= DISPLAY_VALUES).orderBy("position").collect():
            shown[r.column_name].append(r.value)
        counts = {r.column_name: r.asDict() for r in column_counts(raw, tokens).collect()}
        rows = next(iter(counts.values()))["row_count"] if counts else 0
        run.display = {
            "rows": [list(r) for r in raw.limit(DISPLAY_ROWS).collect()], "values": shown, "counts": counts, "row_count": rows, "estimated_seconds": estimate_seconds(rows),
        }
        run.suggested = InstanceConfig({position_key(i): types[c] for i, c in enumerate(run.names)}, run.layout, Options(null_tokens=tokens))
        run.found["suggest"] = issues.confidence_issue(dict.fromkeys(run.names, RULE_CONFIDENCE))
        run.to("AWAITING_CONFIRMATION")
        return self.runs.save(run)

    def _excel_layout(self, path: str) -> SourceFormat:
        name, head = readers.sheet_head(self.spark, path, None, layouts.HEADER_ROWS)
        return SourceFormat("excel", next((i + 1 for i, r in enumerate(head) if layouts.header_like(r)), None), sheet=name)

    def confirm(self, run_id: str, config: InstanceConfig | None = None) -> Run:
        run = self.runs.get(run_id)
        config = config or run.suggested
        if config is None or not config.columns:
            raise InvalidRequest("a confirmed configuration names columns")
        run.to("CONFIRMED")
        run.confirmed = config
        return self.runs.save(run)

    def create_confirmed(self, path: str, config: InstanceConfig) -> Run:
        """A run whose configuration is known, without inference."""
        if not config.columns:
            raise InvalidRequest("a confirmed configuration names columns")
        return self.runs.save(Run(uuid.uuid4().hex, path, "CONFIRMED", config.source, confirmed=config))

    def raw(self, run: Run) -> DataFrame:
        """The source as read once for the run: a Parquet table in the work folder, under canonical names."""
        path = f"{self.work}/{run.id}/raw.parquet"
        if not store.exists(self.spark, f"{path}/_SUCCESS"):
            source = readers.read_source(self.spark, run.path, run.confirmed.source, place="__source_row")
            run.names = canonical_headers(source.columns[:-1])
            source.toDF(*run.names, "__source_row").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def profile(self, run_id: str) -> Run:
        run = self.runs.get(run_id)
        if run.confirmed is None:
            raise InvalidState("profiling needs a confirmed configuration")
        run.to("PROFILING")
        with _failing(run, self.runs):
            raw = self.raw(run)
            columns = run.confirmed.by_name(run.names)
            options = run.confirmed.options
            run.profiles = profile.profile(raw, columns, options.null_tokens, options.approximate_unique)
            run.found["profile"] = issues.dataset_issues(columns, run.confirmed.source) + [i for c, config in columns.items() for i in issues.column_issues(c, config, run.profiles[c])]
        run.to("PROFILED")
        return self.runs.save(run)

    def convert(self, run_id: str, folder: str, checksum: str | None = None, single_file: bool = False) -> Run:
        run = self.runs.get(run_id)
        if not run.profiles:
            raise InvalidState("conversion needs a profile")
        run.to("CONVERTING")
        with _failing(run, self.runs):
            columns, options = run.confirmed.by_name(run.names), run.confirmed.options
            # Converted once; the quality, the table and the trace read the result.  The numbers of source rows rise with the
            # partitions in which the source was read, so their ranges are the order and no sort over the whole table is made.
            whole = convert.convert(self.raw(run), columns, options, convert.sizes_from_profile(run.profiles, columns), placed="__source_row", keep_raw=True)
            made = table(whole, "converted")
            run.quality = quality.quality(made, list(columns)).first().asDict()
            run.quality["columns"] = {r.column_name: r.asDict() for r in quality.column_quality(made, list(columns)).collect()}
            run.artifacts = sinks.publish(made, columns, options, folder, run.quality, run.issues, checksum, single_file)
            store.remove(self.spark, f"{self.work}/{run.id}")
        t = options.thresholds
        run.to(quality.verdict(run.quality["quality_score"], run.quality["worst_column_score"], [i.severity for i in run.issues], t.ready, t.warning))
        return self.runs.save(run)

    def config_json(self, run_id: str) -> str:
        run = self.runs.get(run_id)
        return json.dumps((run.confirmed or run.suggested).to_dict(), sort_keys=True)


class _failing:
    """A step that raises ends its run as FAILED."""

    def __init__(self, run: Run, runs: MemoryStore):
        self.run, self.runs = run, runs

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace):
        if error is not None:
            self.run.status, self.run.failure = "FAILED", str(error)
            self.runs.save(self.run)
        return False
