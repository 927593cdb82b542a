"""The check job: annotations to findings and the report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from annolake.operators.classify import accepted, parse, rejected
from annolake.operators.report import full_report
from annolake.operators.rules import Catalog, CheckOptions, find, unused_datasets
from annolake.sources.tables import extract


@dataclass(frozen=True)
class CheckResult:
    parsed: DataFrame
    rejected: DataFrame
    findings: DataFrame
    unused: DataFrame

    def report(self, run_ts: str, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        return full_report(self.findings, self.unused, run_ts, by)


def check(annotations: DataFrame, catalog: Catalog, options: CheckOptions = CheckOptions(),
          patterns=None, dialect: str = "config") -> CheckResult:
    """Extract, parse and validate; all of it lazy.

    The finding and the unused-dataset branches both read the parsed rows.
    Callers that need more than one of the results may persist ``parsed``.
    """
    rows = parse(extract(annotations), patterns, dialect, catalog.dm_names(),
                 study_keys=catalog.study_keys, salt=options.salt)
    parsed = accepted(rows)
    return CheckResult(parsed, rejected(rows), find(parsed, catalog, options),
                       unused_datasets(parsed, catalog))
