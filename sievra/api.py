"""What an application calls: submit a file, read its report, repair it, take the result."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.detect import Table, analyze
from .operators.repair import apply_fixes
from .plans.report import Report, recommended, undecided
from .sources.tables import ROW, check_upload, read_csv, write_csv


@dataclass
class Job:
    filename: str
    report: Report
    table: Table
    status: str = "analyzed"
    clean_path: str | None = None


class Service:
    """Jobs of one session. Files are read by Spark, so paths may be in any store that it knows."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        self.jobs: dict[str, Job] = {}

    def health(self) -> dict:
        return {"status": "ok"}

    def submit(self, path: str, **options) -> str:
        """Analyses a .csv file of up to 100 MB; returns the job's id."""
        check_upload(path)
        return self.submit_table(read_csv(self.spark, path), path.rsplit("/", 1)[-1], **options)

    def submit_table(self, df: DataFrame, filename: str = "", **options) -> str:
        job_id = str(uuid.uuid4())
        report, table = analyze(df, filename, job_id, **options)
        self.jobs[job_id] = Job(filename, report, table)
        return job_id

    def _job(self, job_id: str) -> Job:
        if job_id not in self.jobs:
            raise KeyError(f"no job {job_id}")
        return self.jobs[job_id]

    def report(self, job_id: str) -> dict:
        return self._job(job_id).report.to_dict()

    def recommended(self, job_id: str) -> dict[str, str]:
        return recommended(self._job(job_id).report.issues)

    def can_fix(self, job_id: str, selections: dict[str, str]) -> bool:
        return not undecided(self._job(job_id).report.issues, selections)

    def fix(self, job_id: str, selections: dict[str, str] | None = None, **options) -> dict:
        """Repairs and writes the table; returns the numbers of rows before, after and removed."""
        job = self._job(job_id)
        clean = apply_fixes(job.table.df, job.report.issues, selections, job.table.found.get("anomalies"), **options)
        path = f"{self.out_dir}/{job_id}_clean"
        write_csv(clean.drop(ROW), path)
        job.status, job.clean_path = "fixed", path
        rows_out = read_csv(self.spark, path).count() if clean.columns else 0
        return {"job_id": job_id, "rows_in": job.report.rows_analyzed, "rows_out": rows_out, "rows_removed": job.report.rows_analyzed - rows_out}

    def download(self, job_id: str) -> str:
        """Where the repaired table lies."""
        job = self._job(job_id)
        if not job.clean_path:
            raise ValueError("not repaired yet")
        return job.clean_path
