"""State machines of estimates, vendor requests and questions: which steps no table draws, and which need a named person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The states that each state may go to.
VERSION = {"draft": ["priced", "superseded"], "priced": ["pendingReview", "superseded"], "pendingReview": ["draft", "approved", "superseded"], "approved": ["sent", "superseded"], "sent": ["superseded"], "superseded": []}
RFQ = {"draft": ["requested", "cancelled"], "requested": ["awaiting", "cancelled"], "awaiting": ["received", "expired", "cancelled"], "received": ["applied", "expired", "cancelled"], "applied": [], "expired": [], "cancelled": []}
RFI = {"open": ["sent", "withdrawn"], "sent": ["answered", "withdrawn"], "answered": ["closed"], "closed": [], "withdrawn": []}
MACHINES = {"version": VERSION, "rfq": RFQ, "rfi": RFI}
#: States that only a named person may choose.
HUMAN_ONLY = ["approved"]


def next_states(machine: str, current: Column) -> Column:
    """The states that a machine's state may go to; none of a state it does not know."""
    table = F.create_map(*[x for state, after in MACHINES[machine].items() for x in (F.lit(state), F.array(*map(F.lit, after)).cast("array<string>"))])
    return F.coalesce(F.try_element_at(table, current), F.array().cast("array<string>"))


def judged_steps(history: DataFrame, machine: str, key: str, order: list[Column]) -> DataFrame:
    """history (key, status, actor, system) with was, allowed and fault of each step.

    fault: transition, where the machine does not draw the step (allowed says what it does draw), person, where a state that a
    person must choose was chosen by nobody and not by the system following one, else null. The first state of a key is no step.
    """
    rows = history.withColumn("was", F.lag("status").over(W.partitionBy(key).orderBy(*order))).where("was IS NOT NULL")
    rows = rows.withColumn("allowed", next_states(machine, F.col("was")))
    nobody = F.trim(F.coalesce("actor", F.lit(""))) == ""
    person = F.col("status").isin(HUMAN_ONLY) & ~F.coalesce("system", F.lit(False)) & nobody
    drawn = F.coalesce(F.array_contains("allowed", F.col("status")), F.lit(False))
    return rows.withColumn("fault", F.when(~drawn, "transition").when(person, "person"))
