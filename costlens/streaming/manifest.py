"""Versions of the serving tables: which folders make up rollup and alerts now (see ``costlens.files``)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from costlens import files as V
from costlens.files import Files, versions

__all__ = ["Files", "Manifest", "commit", "latest", "vacuum", "versions"]


@dataclass(frozen=True)
class Manifest:
    """``rollup`` and ``alerts`` map a part (``day=../bucket=..``) to the folder that holds its rows.

    ``batches`` has the last micro-batch of each stream that is in the tables,
    ``days`` the days that a reconcile has made complete.
    """

    version: int = 0
    rollup: dict[str, str] = field(default_factory=dict)
    alerts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    days: list[str] = field(default_factory=list)


def latest(files: Files) -> Manifest:
    return Manifest(**V.latest(files))


def commit(files: Files, made: Manifest) -> bool:
    return V.commit(files, made.version, asdict(made))


def vacuum(files: Files, keep: int) -> int:
    return V.vacuum(files, keep, ("rollup", "alerts"), lambda m: {*m["rollup"].values(), *m["alerts"].values()})
