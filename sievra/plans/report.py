"""Issues and reports: plain records for the driver, and the same as a DataFrame."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab as V

SCHEMA = (
    "issue_type string, column string, severity string, fix_tier string, affected_rows long, total_rows long, affected_pct double, "
    "examples array<string>, suggested_fix string, confidence double, fix_options array<struct<label:string,action:string,preview:string>>"
)
_RANK = {V.HIGH: 0, V.MEDIUM: 1, V.LOW: 2}


@dataclass
class FixOption:
    label: str
    action: str
    preview: str


@dataclass
class Issue:
    issue_type: str
    column: str | None
    severity: str
    fix_tier: str
    affected_rows: int
    total_rows: int
    examples: list[str]
    suggested_fix: str
    confidence: float
    fix_options: list[FixOption] = field(default_factory=list)

    @property
    def key(self) -> str:
        return f"{self.column}:{self.issue_type}"

    @property
    def affected_pct(self) -> float:
        return round(self.affected_rows / self.total_rows * 100, 1) if self.total_rows else 0.0

    def to_dict(self) -> dict:
        d = asdict(self)
        return {k: d[k] for k in ("issue_type", "column", "severity", "fix_tier", "affected_rows", "total_rows")} | {"affected_pct": self.affected_pct} | {k: d[k] for k in ("examples", "suggested_fix", "confidence", "fix_options")}


@dataclass
class Report:
    job_id: str
    filename: str
    rows_analyzed: int
    cols_analyzed: int
    issues: list[Issue] = field(default_factory=list)
    processing_ms: int = 0

    def to_dict(self) -> dict:
        return {
            "job_id": self.job_id,
            "filename": self.filename,
            "rows_analyzed": self.rows_analyzed,
            "cols_analyzed": self.cols_analyzed,
            "total_issues": len(self.issues),
            "issues": [i.to_dict() for i in self.issues],
            "processing_ms": self.processing_ms,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)


def by_severity(issues: list[Issue]) -> list[Issue]:
    return sorted(issues, key=lambda i: _RANK.get(i.severity, 3))


def issues_frame(spark: SparkSession, issues: list[Issue]) -> DataFrame:
    return spark.createDataFrame([i.to_dict() for i in issues], SCHEMA)


def recommended(issues: list[Issue]) -> dict[str, str]:
    """The first option of every issue that the user has to decide."""
    return {i.key: i.fix_options[0].action for i in issues if i.fix_tier == V.SUGGEST and i.fix_options}


def undecided(issues: list[Issue], selections: dict[str, str]) -> list[Issue]:
    """Issues that wait for a decision."""
    return [i for i in issues if i.fix_tier == V.SUGGEST and i.key not in selections]
