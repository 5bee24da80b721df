"""Messages about reports and failures, for any channel that takes JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def report_message(title: str, lines: DataFrame) -> dict:
    """A message of a report's lines (``gold.report_lines``, seven rows)."""
    rows = [f"{r['metric']:<12}{r['shown']:>10}{r['wow']:>10}{r['mom']:>10}" for r in lines.collect()]
    return {"title": title, "text": "\n".join(rows)}


def failure_message(job: str, error: BaseException, attempt: int) -> dict:
    return {"title": f"{job} failed", "text": f"attempt {attempt}: {type(error).__name__}: {str(error)[:500]}"}


def notify(message: dict, post: Callable[[dict], None] | None) -> bool:
    """Hands the message to ``post``; whether it went out. No channel, or one that fails, never ends the job."""
    if post is None:
        return False
    try:
        post(message)
        return True
    except Exception:  # noqa: BLE001 - a message is never worth the job
        return False
