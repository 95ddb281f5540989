"""Runs on the driver: a workspace with its manifest, guarded outputs, stages with a log, a chain that stops at a failure.

A workspace lies in a folder that driver and executors see: an absolute path, or a URI of a file system that Spark and Arrow know. Tables
in it are written by Spark, manifest and logs by the driver through Arrow's file systems.
"""

from __future__ import annotations

import json
import time
import traceback
import unicodedata
import re
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .functions.text import clean_scalar
from .sources.formats import place

#: Tables and files of a workspace, by stage.
FILES = {
    "input": "input_records", "stage1": "outputs/stage1_sorted_timeline", "stage2": "outputs/stage2_verified_facts", "reference": "reference_examples",
    "style_cache": "outputs/fewshot_professor_style_prompts", "notes": "outputs/generated_notes", "audit": "outputs/generated_notes_audit", "manifest": "manifest.json",
}
FOLDERS = ("uploads/input_documents", "uploads/style_samples", "prof_samples", "outputs", "logs")


def safe_name(label: str, default: str, longest: int) -> str:
    """A name for files that keeps Hangul, as functions.text.slug makes it."""
    t = re.sub(r"\s+", "_", unicodedata.normalize("NFC", label or "").strip())
    return (re.sub(r"[^\w가-힣.-]+", "_", t).strip("._-") or default)[:longest]


@dataclass(frozen=True)
class Shared:
    """A file or folder on the cluster's file system; as text, what Spark takes as a path."""

    uri: str

    def __str__(self) -> str:
        return self.uri

    def __truediv__(self, name: str) -> Shared:
        return Shared(f"{self.uri.rstrip('/')}/{name}")

    @property
    def name(self) -> str:
        return self.uri.rstrip("/").rpartition("/")[2]

    def _kind(self) -> fs.FileType:
        system, path = place(self.uri)
        return system.get_file_info(path).type

    def exists(self) -> bool:
        return self._kind() != fs.FileType.NotFound

    def is_dir(self) -> bool:
        return self._kind() == fs.FileType.Directory

    def mkdir(self) -> None:
        system, path = place(self.uri)
        system.create_dir(path)

    def children(self) -> list[Shared]:
        system, path = place(self.uri)
        return [self / x.base_name for x in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda x: x.base_name)]

    def read_text(self) -> str:
        system, path = place(self.uri)
        with system.open_input_stream(path, compression=None) as f:
            return f.read().decode()

    def write_text(self, text: str) -> None:
        system, path = place(self.uri)
        with system.open_output_stream(path, compression=None) as f:
            f.write(text.encode())


def shared(path: str | Path | Shared) -> Shared:
    """Of a path; one without a scheme is made absolute."""
    text = str(path)
    return Shared(text if re.match(r"[\w+.-]{2,}:/", text) else str(Path(text).expanduser().resolve()))


@dataclass(frozen=True)
class Run:
    """A run's name and folder; path(name) of what FILES lists."""

    run_id: str
    root: Shared

    def path(self, name: str) -> Shared:
        return self.root / FILES[name]

    def paths(self) -> dict[str, str]:
        return {k: str(self.root / v) for k, v in FILES.items()}

    def artifacts(self) -> list[Shared]:
        """What of FILES is there; a table counts once it is complete."""
        return [p for k in FILES if _there(p := self.path(k))]

    def state(self) -> dict[str, bool]:
        return {k: _there(self.path(k)) for k in ("input", "stage1", "stage2", "notes")}


def _there(path: Shared) -> bool:
    return (path / "_SUCCESS").exists() if path.is_dir() else path.exists()


def create_run(base: str | Path, label: str, tries: int = 8) -> Run:
    """A new workspace named by the time in UTC, the label and eight random digits."""
    for _ in range(tries):
        name = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%fZ}_{safe_name(label, 'run', 36)}_{uuid.uuid4().hex[:8]}"
        root = shared(base) / name
        if root.exists():
            continue
        for folder in FOLDERS:
            (root / folder).mkdir()
        return Run(name, root)
    raise RuntimeError(f"no unique workspace in {base}")


def write_manifest(run: Run, input_rows: int, style_rows: int, warnings: Sequence[str], saved_files: Sequence[dict]) -> dict:
    """run_id, created_at, paths, counts of rows, warnings and saved files; also written to the workspace."""
    out = {"run_id": run.run_id, "created_at": datetime.now(timezone.utc).isoformat(), "paths": run.paths(), "input_rows": input_rows, "style_sample_rows": style_rows, "warnings": list(warnings), "saved_files": list(saved_files)}
    run.path("manifest").write_text(json.dumps(out, ensure_ascii=False, indent=2))
    return out


def latest_facts(base: str | Path) -> Shared | None:
    """The facts of the run that was started last and has them."""
    done = [p for p in shared(base).children() if _there(p / FILES["stage2"])]
    return done[-1] / FILES["stage2"] if done else None


def check_paths(inputs: dict[str, str | Path], outputs: dict[str, str | Path]) -> None:
    """An error if an output is one of the inputs, or two outputs are one."""
    plain = lambda x: re.sub("^file:/+", "/", str(shared(x))).rstrip("/")
    for name, out in outputs.items():
        if same := [k for k, x in inputs.items() if plain(x) == plain(out)]:
            raise ValueError(f"{name} must not overwrite {same[0]}: {out}")
    if len({plain(x) for x in outputs.values()}) != len(outputs):
        raise ValueError(f"outputs must differ: {outputs}")


def done_keys(existing: DataFrame, columns: Sequence[str], settings: dict[str, object] | None = None) -> DataFrame:
    """professor, record_id of rows that a resumed run need not do again.

    An error if the existing output lacks the keys, has another header, or has rows made with other settings
    (column: value; blank cells agree with any).
    """
    if missing := {"professor", "record_id"} - set(existing.columns):
        raise ValueError(f"the existing output lacks {sorted(missing)}")
    if list(existing.columns) != list(columns):
        raise ValueError(f"the existing output has the columns {existing.columns}, this run {list(columns)}")
    for column, value in (settings or {}).items():
        other = existing.select(clean_scalar(F.col(column)).alias("x")).where((F.col("x") != "") & (F.col("x") != str(value))).first()
        if other:
            raise ValueError(f"existing rows were made with {column}={other['x']}, this run uses {value}")
    return existing.select(clean_scalar("professor").alias("professor"), clean_scalar("record_id").alias("record_id")).distinct()


@dataclass
class StageResult:
    """How one stage ended: its settings, its error if it failed, its seconds."""

    stage: str
    settings: dict = field(default_factory=dict)
    error: str = ""
    duration_seconds: float = 0.0

    @property
    def ok(self) -> bool:
        return not self.error


def run_stage(run: Run, name: str, work: Callable[[], object], **settings) -> StageResult:
    """work() with its log in the workspace; an exception ends the stage, not the program."""
    began = time.monotonic()
    result = StageResult(name, {k: str(v) for k, v in settings.items()})
    try:
        work()
    except Exception:  # noqa: BLE001  a stage's failure is its result
        result.error = traceback.format_exc()
    result.duration_seconds = round(time.monotonic() - began, 3)
    text = json.dumps(asdict(result) | {"ok": result.ok}, ensure_ascii=False, indent=2)
    (run.root / "logs" / f"{safe_name(name, 'stage', 64)}.json").write_text(text)
    return result


def side_by_side(spark: SparkSession, run: Run, stages: Sequence[tuple[str, Callable[[], object]]], jobs: int) -> list[StageResult]:
    """Stages that do not need each other, from one queue, ``jobs`` at a time; one that fails leaves the others. Each runs in a
    scheduler pool of its own name, so that in a session of the FAIR mode small ones are not held up by large ones."""

    def one(name: str, work: Callable[[], object]) -> StageResult:
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", safe_name(name, "stage", 64))
        try:
            return run_stage(run, name, work)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, jobs)) as threads:
        started = [threads.submit(inheritable_thread_target(spark)(one), *stage) for stage in stages]
        return [s.result() for s in started]


def chain(run: Run, stages: Sequence[tuple[str, Callable[[], object]]]) -> list[StageResult]:
    """Stages one after the other, up to the first that fails."""
    out: list[StageResult] = []
    for name, work in stages:
        out.append(run_stage(run, name, work))
        if not out[-1].ok:
            break
    return out
