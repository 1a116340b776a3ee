"""Where a dataset's parts lie: a root, its image folders and its annotation file, found by name."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIABLE = "MASKFRAME_DATA"
# The places that are searched, and the folders' names.
PLACES = ("/kaggle/input", "./data")
TRAIN, TEST = "train_images", "test_images"


@dataclass(frozen=True)
class DataPaths:
    root: Path
    train_images: Path
    test_images: Path | None
    annotations: Path


def _folders(base: Path, name: str) -> list[Path]:
    return sorted(Path(d) / name for d, subs, _ in os.walk(base) if name in subs)


def find_root(explicit: str | None = None, places: tuple[str, ...] = PLACES) -> Path:
    """The argument, else the environment, else the folder two levels above the first training folder found."""
    for given in (explicit, os.environ.get(VARIABLE)):
        if given:
            if not Path(given).is_dir():
                raise FileNotFoundError(given)
            return Path(given)
    for place in places:
        found = _folders(Path(place), TRAIN)
        if found:
            return found[0].parent.parent
    raise FileNotFoundError(f"no folder {TRAIN} below {', '.join(places)}")


def annotation_rank(path: str) -> tuple:
    """Sort key: file names with 'annotation' first, then with 'train', then shorter paths, then by the path's parts."""
    parts = path.split("/")
    low = parts[-1].lower()
    return ("annotation" not in low, "train" not in low, len(path), parts)


def first_annotations(files: DataFrame, path: str = "path") -> DataFrame:
    """The row of ``files`` whose path comes first by ``annotation_rank``."""
    parts = F.split(path, "/")
    low = F.lower(F.element_at(parts, -1))
    return files.orderBy(~F.contains(low, F.lit("annotation")), ~F.contains(low, F.lit("train")), F.length(path), parts).limit(1)


def find_annotations(root: Path) -> Path:
    files = sorted(root.rglob("*.json"))
    if not files:
        raise FileNotFoundError(f"no annotation file below {root}")
    return min(files, key=lambda p: annotation_rank(str(p)))


def resolve(root: Path) -> DataPaths:
    train, test = _folders(root, TRAIN), _folders(root, TEST)
    if not train:
        raise FileNotFoundError(f"no folder {TRAIN} below {root}")
    return DataPaths(root, train[0], test[0] if test else None, find_annotations(root))
