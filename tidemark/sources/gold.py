"""Expectations written down as YAML or JSON: answer cases and date-resolution cases."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.dates import AMBIGUOUS, ASSUMED, STATED
from tidemark.plans.ask import ANSWERED, OUTCOMES

CASES = "case_id string, question string, section_key string, valid_at date, known_at timestamp, klass string, must_contain array<string>, must_not_contain array<string>, expected string"
RESOLUTIONS = "case_id string, question string, expected string, valid_at date, moves_known_at boolean"


def _load(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml  # only YAML needs it

    return yaml.safe_load(text)


def _day(value: object) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _moment(value: object) -> dt.datetime:
    at = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


def _one_of(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    """Answer cases, resolution cases and the corpus revision they were written against.

    The file is small and read by the driver; an unknown outcome is an error.
    """
    data = _load(path)
    cases = [
        (c["id"], c["question"], c.get("section"), _day(c["valid_at"]), _moment(c["known_at"]), c["class"], list(c.get("must_contain", [])), list(c.get("must_not_contain", [])), _one_of(c.get("expect_outcome", ANSWERED), OUTCOMES))
        for c in data.get("cases", [])
    ]
    resolutions = [(c["id"], c["question"], _one_of(c["expect"], (STATED, ASSUMED, AMBIGUOUS)), _day(c.get("valid_at")), bool(c.get("moves_known_at", False))) for c in data.get("resolution_cases", [])]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(resolutions, RESOLUTIONS), data.get("corpus_rev")
