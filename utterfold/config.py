"""Settings of a corpus and the checks made before any job starts."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

log = logging.getLogger("utterfold")

MULTICLASS = "multiclass"
MULTILABEL = "multilabel"
TASKS = (MULTICLASS, MULTILABEL)


@dataclass(frozen=True)
class CorpusConfig:
    """Where a labelled corpus lies and how its labels are to be read."""

    path: str
    text_col: str = "text"
    label_col: str | None = "label"
    columns: Sequence[str] | None = None
    file_type: str | None = None
    task: str = MULTICLASS
    unpack: bool = False
    delimiter: str | None = "+"
    null_label: str | None = None
    validation_ratio: float = 0.2
    seed: int = 42
    max_tokens: int = 128


def check_task(task: str) -> None:
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}, expected one of {', '.join(TASKS)}")


def validate_config(config: CorpusConfig) -> None:
    """Refuse settings that cannot work; warn about the one that only looks odd."""
    check_task(config.task)
    if config.unpack:
        if not config.label_col or not config.delimiter:
            raise ValueError("unpacking labels needs both a label column and a delimiter")
        if config.columns and config.label_col not in config.columns:
            raise ValueError(
                f"label column {config.label_col!r} is not among the given columns "
                f"{list(config.columns)}"
            )
    if config.task == MULTILABEL and not config.unpack:
        raise ValueError("a multilabel task needs unpack=True")
    if config.task == MULTICLASS and config.unpack:
        log.warning("multiclass task with unpacked labels: a text may get several rows")


def require_column(columns: Sequence[str], name: str, role: str) -> None:
    if name not in columns:
        raise ValueError(f"{role} column {name!r} not found, available: {list(columns)}")
