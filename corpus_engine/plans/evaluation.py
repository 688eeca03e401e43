"""The evaluation run: every ready site's cases, asked, scored and summed up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.operators.analytics import eval_summary, failed_questions
from corpus_engine.operators.jobs import explode_eval_dataset, score_evals
from corpus_engine.runtime import durable


@dataclass(frozen=True)
class EvaluationRun:
    """Scored cases, one log row per site, and the questions behind each warning."""

    results: DataFrame
    log: DataFrame
    warnings: DataFrame


def run_evaluations(
    sites: DataFrame, settings: DataFrame, answer: Callable[[DataFrame], DataFrame], nightly: bool = True
) -> EvaluationRun:
    """Evaluate all sites of status ``ready`` that have cases.

    ``answer`` maps cases ``(case_id, agent_id, case_no, question)`` to ``(case_id, answer,
    confidence, sources_only)``; a case it leaves out fails. The scored cases are written
    once, because answering costs more than reading them back.
    """
    ready = sites.filter("status = 'ready'").select("agent_id")
    cases = explode_eval_dataset(settings.join(ready, "agent_id", "left_semi"))
    cases = durable(cases.withColumn("case_id", F.concat_ws("-", "agent_id", "case_no")))
    answers = answer(cases.select("case_id", "agent_id", "case_no", "question"))
    scored = score_evals(cases, answers, nightly).join(cases.select("case_id", "agent_id", "case_no"), "case_id")
    results = durable(scored)
    log = eval_summary(results, "agent_id").withColumn("action", F.lit("nightly_eval_completed"))
    return EvaluationRun(results, log, failed_questions(results, "agent_id"))
