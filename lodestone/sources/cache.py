"""Read-through caches on disk: downloaded benchmark pairs, and answers that a model has given."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .tables import read_pair


def put(path: Path, data: bytes) -> None:
    """The file appears complete under its name, or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.replace(temp, path)


def cached_pair(spark: SparkSession, name: str, folder: str, fetch: Callable[[str, str], bytes] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dirty, clean, truth) of a benchmark pair kept as dirty.csv and clean.csv below ``folder``/``name``.

    What is missing comes from ``fetch`` (name, 'dirty' or 'clean'); both parts are fetched before either
    is kept, so a failed download leaves no half pair. Without ``fetch`` a missing part is an error.
    """
    paths = {part: Path(folder, name, f"{part}.csv") for part in ("dirty", "clean")}
    missing = [part for part, p in paths.items() if not p.exists()]
    if missing and fetch is None:
        raise FileNotFoundError(f"put {' and '.join(f'{m}.csv' for m in missing)} of {name} into {paths['dirty'].parent}")
    for part, data in {part: fetch(name, part) for part in missing}.items():
        put(paths[part], data)
    return read_pair(spark, str(paths["dirty"]), str(paths["clean"]))


class AnswerCache:
    """A model's chosen values by prompt and model. A file that can't be read counts as missing."""

    def __init__(self, folder: str, model: str):
        self.folder, self.model = Path(folder), model

    def path(self, prompt: str) -> Path:
        return self.folder / f"{hashlib.sha256(prompt.encode()).hexdigest()}_{self.model.replace('/', '_')}.json"

    def get(self, prompt: str) -> str | None:
        try:
            return str(json.loads(self.path(prompt).read_text(encoding="utf-8"))["chosen_value"])
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def put(self, prompt: str, value: str, raw: str) -> None:
        found = {"prompt_hash": hashlib.sha256(prompt.encode()).hexdigest(), "model": self.model, "chosen_value": value, "raw_response": raw}
        put(self.path(prompt), json.dumps(found, sort_keys=True).encode())

    def resolve(self, prompt: str, complete: Callable[[str], str] | None = None) -> tuple[str, str] | None:
        """(value, provenance): the cached answer, else what ``complete`` answers if that names a value."""
        if (known := self.get(prompt)) is not None:
            return known, "llm_cache"
        if complete is None:
            return None
        raw = complete(prompt)
        try:
            value = str(json.loads(raw)["chosen_value"])
        except (ValueError, KeyError, TypeError):
            return None
        self.put(prompt, value, raw)
        return value, "llm_live"
