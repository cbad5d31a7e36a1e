"""One row a run: what it came to, from its state to what it cost."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.states import empty_result


def run_report(states: DataFrame, answers: DataFrame, summary: DataFrame, usage: DataFrame, unread: DataFrame) -> DataFrame:
    """``(run_id, state, reason, orphans, answer, sources_total, sources_opened, input, output, total_tokens, cost, empty, unread, note)`` of every run.

    ``states`` as from ``states.run_state``, ``answers`` as from ``evidence.final_answer``, ``summary`` as from ``evidence.source_summary``, ``usage`` as
    from ``evidence.usage_totals``, ``unread`` as from ``states.unread_note``. A run without a turn has an empty answer and no sources.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = states.join(answers, "run_id", "left").join(summary, "run_id", "left").join(usage, "run_id", "left").join(unread, "run_id", "left")
    return empty_result(joined.select("run_id", "state", "reason", "orphans", F.coalesce("answer", F.lit("")).alias("answer"), zero("sources_total"), zero("sources_opened"),
                                      zero("input"), zero("output"), zero("total_tokens"), F.coalesce("cost", F.lit(0.0)).alias("cost"), zero("unread"), "note"))
