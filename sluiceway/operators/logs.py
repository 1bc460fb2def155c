"""Logging, with the partition in front where there is one."""

from __future__ import annotations

import logging
import os

NAME = "sluiceway"


class PartitionFormatter(logging.Formatter):
    """Puts `[Part p]` before what is logged inside a task."""

    def format(self, record: logging.LogRecord) -> str:
        from pyspark import TaskContext

        context = TaskContext.get()
        text = super().format(record)
        return text if context is None else f"[Part {context.partitionId()}] {text}"


def setup_logging(level: int | str = logging.WARNING, log_file: str | None = None) -> logging.Logger:
    """Console, and a file that is appended to if one is named.  Earlier handlers go.  Importing the
    package calls this with LOG_LEVEL and LOG_FILE of the environment, if either is set."""
    logger = logging.getLogger(NAME)
    logger.setLevel(level)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    for handler in [logging.StreamHandler(), *([logging.FileHandler(log_file)] if log_file else [])]:
        handler.setFormatter(PartitionFormatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    logger.propagate = False
    return logger


def setup_from_environment() -> None:
    level, log_file = os.environ.get("LOG_LEVEL"), os.environ.get("LOG_FILE")
    if level or log_file:
        setup_logging((level or "WARNING").upper(), log_file or None)
