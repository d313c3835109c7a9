"""Runs: configuration hash, stage markers, manifests.  Small driver files, no data."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from .operators.corpus import fingerprint
from .sources.sinks import write_json

#: Sections of a configuration that do not change results.
OPERATIONAL = ("runtime", "tracking", "scale")
PREREQUISITES = {"ingest": (), "clean": ("ingest",), "dedup": ("clean", "eval_design"), "contamination": ("dedup", "eval_design"), "tokenize": ("contamination",), "eval_design": ()}


class StaleStage(RuntimeError):
    """A stage that is missing or was made under another configuration."""


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def canonical_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def config_hash(config: dict, defaults: dict | None = None) -> str:
    """The hash of what results depend on: operational sections and default values left out."""

    def prune(v, d):
        if not isinstance(v, dict):
            return v
        return {k: prune(x, (d or {}).get(k) if isinstance(d, dict) else None) for k, x in v.items() if not (isinstance(d, dict) and k in d and d[k] == x)}

    return canonical_hash(prune({k: v for k, v in config.items() if k not in OPERATIONAL}, defaults or {}))


def override(config: dict, path: str, value) -> dict:
    """A copy of the configuration with one dotted path set; an unknown path is an error."""
    out = json.loads(json.dumps(config))
    at = out
    *parents, last = path.split(".")
    for p in parents:
        if not isinstance(at.get(p), dict):
            raise KeyError(path)
        at = at[p]
    if last not in at:
        raise KeyError(path)
    at[last] = value
    return out


@dataclass
class Run:
    """A run directory with markers of finished stages."""

    root: str
    hash: str

    def _marker(self, stage: str) -> str:
        return os.path.join(self.root, "artifacts", f"{stage}.done.json")

    def marker(self, stage: str) -> dict | None:
        try:
            with open(self._marker(stage), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def current(self, stage: str) -> bool:
        got = self.marker(stage)
        return bool(got) and got["config_hash"] == self.hash

    def require(self, stage: str) -> None:
        for before in PREREQUISITES.get(stage, ()):
            if not self.current(before):
                raise StaleStage(f"{stage} needs a current {before}")

    def finish(self, stage: str, output: DataFrame, path: str, **counts) -> dict:
        """Marks a stage: its output's rows and fingerprint, whatever their order."""
        rows, mark = fingerprint(output)
        got = {"stage": stage, "config_hash": self.hash, "finished_at": now(), "output": path, "rows": rows, "fingerprint": f"{mark:016x}", **counts}
        write_json(got, self._marker(stage))
        return got

    def verify(self, stage: str, output: DataFrame) -> None:
        """Holds a stage's stored output against its marker before it is used."""
        got = self.marker(stage)
        rows, mark = fingerprint(output)
        if not got or (got["rows"], got["fingerprint"]) != (rows, f"{mark:016x}"):
            raise StaleStage(f"the output of {stage} is not what its marker says")


def require_rows(stage: str, rows: int) -> None:
    """Ingest, clean, dedup and tokenize may not end empty."""
    if rows == 0:
        raise ValueError(f"{stage} produced no documents")
