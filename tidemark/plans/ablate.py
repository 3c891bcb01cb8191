"""The ablation matrix: every layer taken out in turn, and what turned red."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.plans.ask import BREAKS, Options


@dataclass(frozen=True)
class Ablation:
    """One break: its newly red cases, or the error of a run that crashed.  A crash shows nothing about the layer."""

    name: str
    newly_red: tuple[str, ...] = ()
    error: str | None = None


def ablate(outcomes: Callable[[Options], DataFrame], breaks: dict[str, Options] = BREAKS, whole: Options = Options()) -> list[Ablation]:
    """Run ``outcomes`` (a frame ``case_id, status``) under every break and compare with the whole engine's failures.

    The whole engine must run; its crash is raised.
    """
    failed = lambda options: {r["case_id"] for r in outcomes(options).where("status <> 'ok'").select("case_id").collect()}
    known = failed(whole)
    out = []
    for name, options in breaks.items():
        try:
            out.append(Ablation(name, tuple(sorted(failed(options) - known))))
        except Exception as e:  # one break that crashes must not hide the others
            out.append(Ablation(name, error=f"{type(e).__name__}: {e}".splitlines()[0][:200]))
    return out
