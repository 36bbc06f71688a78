"""Sources that fail: retried if the fault may pass, given up if it can't."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
#: Conditions that no retry can mend.
PERMANENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "DATA_SOURCE_NOT_FOUND", "UNRESOLVED_COLUMN")


def permanent(fault: Exception) -> bool:
    """Whether a fault says that the source isn't there or isn't what it should be."""
    if isinstance(fault, PySparkException) and str(fault.getCondition() or "").startswith(PERMANENT):
        return True
    return isinstance(fault, (AnalysisException, FileNotFoundError, PermissionError))


def scanned(open_source: Callable[[], DataFrame], retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame | None:
    """The source's rows after a first row could be read; None if it had to be given up.

    Waits min(60, 5 * 2^attempt) seconds between attempts. Faults in the middle of a job
    are Spark's to retry, and a failed task's rows are thrown away, so that none repeats.
    """
    for attempt in range(retries):
        try:
            rows = open_source()
            rows.head(1)
            return rows
        except Exception as fault:  # any fault of a source
            if permanent(fault):
                log.warning("source given up, as no retry helps: %s", fault)
                return None
            if attempt + 1 < retries:
                sleep(min(60, 5 * 2**attempt))
    log.warning("source given up after %d attempts", retries)
    return None


def resumed(rows: DataFrame, order: str, seen: int) -> DataFrame:
    """The rows of an ordered source behind the ``seen`` first ones.

    ``order`` numbers the rows from 0, so that the skip is a filter that reaches the
    scan. What a reader had gathered of a group when it broke off is not among them: a
    group starts anew with the first row after the break.
    """
    return rows.where(rows[order] >= seen)
