"""End-to-end analysis (PIPE2, PIPE3).

read -> preprocess -> score -> severity -> every statistic. The scored table
is staged once in the shared checkpoint folder; the ~10 figures of the
dashboard then scan that columnar copy (each a small aggregate or a bounded
top-k) instead of re-running parsing, features and the model per figure.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from logsight.operators import model as M
from logsight.operators import report as R
from logsight.operators import stats as ST
from logsight.operators.clean import cleaning_report, preprocess
from logsight.operators.severity import assign_severity
from logsight.session import stage


@dataclass
class Analysis:
    scored: DataFrame
    figures: dict[str, DataFrame] = field(default_factory=dict)


def compute_stats(scored: DataFrame) -> dict[str, DataFrame]:
    """PIPE3: every dashboard figure from one (staged) scored table."""
    return {
        "totals": ST.totals(scored),
        "category_breakdown": ST.category_breakdown(scored),
        "severity_breakdown": ST.severity_breakdown(scored),
        "top_ips": ST.top_attacker_ips(scored),
        "top_users": ST.top_targeted_users(scored),
        "top_ports": ST.top_targeted_ports(scored),
        "timeline": ST.attack_timeline(scored),
        "top_detections": ST.top_detections(scored),
        "timeline_reason": ST.timeline_reason(scored),
        "report_tables": R.report_tables(scored),
        "summary": R.summary_sentences(scored),
        "reliability": M.reliability_warning(scored),
    }


def analyse(events: DataFrame, model: PipelineModel, assume_year: int | None = None,
            with_report: bool = True) -> Analysis:
    """PIPE2 over canonical events. Raises ValueError when cleaning leaves no rows."""
    # the dedupe and the cleaning report read the same parsed rows
    events = stage(events, "events")
    clean = stage(preprocess(events, assume_year), "clean")
    if clean.isEmpty():
        raise ValueError("after cleaning, no rows were left to analyse")
    # the severity reads the scores twice (attacks of each IP, and the rows): the model runs once
    scored = stage(assign_severity(stage(M.score(model, clean), "scores")), "scored")
    figures = compute_stats(scored)
    if with_report:
        figures["cleaning_report"] = cleaning_report(events, assume_year)
        figures["projection"] = M.project_2d(scored)
    return Analysis(scored=scored, figures=figures)
