"""Local model files: where a model lies, what is missing of it, and taking it away."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class ModelStatus:
    """What is there of a model's files."""

    expected: int
    present: int
    bytes_present: int
    missing: tuple[str, ...]

    @property
    def complete(self) -> bool:
        return not self.missing


def inside(folder: Path, relative: str) -> Path:
    """A path below a folder; one that leaves it is refused."""
    path = (folder / relative).resolve()
    if not relative or folder.resolve() not in path.parents:
        raise ValueError(f"not a path below {folder}: {relative!r}")
    return path


def resolve(folder: str | Path, preferred: Iterable[str], override: str | None = None) -> Path:
    """The model file: that of the override variable if it is set, else the first of the preferred ones that exists."""
    if override and os.environ.get(override):
        return Path(os.environ[override])
    wanted = list(preferred)
    for name in wanted:
        path = inside(Path(folder), name)
        if path.exists():
            return path
    raise FileNotFoundError(f"none of {', '.join(wanted)} below {folder}")


def status(folder: str | Path, files: dict[str, int | None]) -> ModelStatus:
    """Status against a catalog of relative paths and sizes; a file of another size than the catalog's is missing."""
    there = {}
    for name, size in files.items():
        path = inside(Path(folder), name)
        if path.is_file() and (size is None or path.stat().st_size == size):
            there[name] = path.stat().st_size
    return ModelStatus(len(files), len(there), sum(there.values()), tuple(n for n in files if n not in there))


def delete(folder: str | Path, files: dict[str, int | None], variable: str | None = None) -> ModelStatus:
    """Remove a model's folder; the variable that names a model folder is cleared only if it names this one."""
    place = Path(folder)
    if variable and os.environ.get(variable) and Path(os.environ[variable]).resolve() == place.resolve():
        del os.environ[variable]
    shutil.rmtree(place, ignore_errors=True)
    return status(place, files)
