"""Settings from the environment, read when load() is called."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass
class Config:
    index: str
    data_dir: str
    embedder: str
    answer: bool
    host: str
    port: int
    watching: bool = False


def load() -> Config:
    get = os.environ.get
    return Config(get("LODESTRATA_INDEX", "lodestrata_index"), get("LODESTRATA_DATA", "data"), get("LODESTRATA_EMBEDDER", "auto"), get("LODESTRATA_ANSWER", "0") == "1", get("LODESTRATA_HOST", "127.0.0.1"), int(get("LODESTRATA_PORT", "8080")))
