"""Log events as lines of JSON, from the driver."""

from __future__ import annotations

import json
import logging
import time

LOGGER = logging.getLogger("gristmill")
#: Progress is told at the first batch and at each multiple of this.
EVERY = 10


def event(name: str, **fields) -> None:
    """An event with fields of its own, which the formatter puts beside the time and level."""
    LOGGER.info(name, extra={"fields": {"event": name, **fields}})


def progress(batches: int, rows: int) -> None:
    if batches == 1 or batches % EVERY == 0:
        event("stream_progress", batches=batches, rows=rows)


class JsonLines(logging.Formatter):
    """One JSON object a record with its keys in order; what isn't an event has ``message``."""

    def format(self, record: logging.LogRecord) -> str:
        told = {
            "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S+0000", time.gmtime(record.created)),
            "level": record.levelname,
            "logger": record.name,
        }
        told |= getattr(record, "fields", None) or {"message": record.getMessage()}
        if record.exc_info:
            told["exception"] = self.formatException(record.exc_info)
        return json.dumps(told, sort_keys=True, default=str)


def to_stderr() -> None:
    """Sends all log records of the driver to stderr in that form."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logging.basicConfig(level=logging.INFO, handlers=[handler], force=True)
