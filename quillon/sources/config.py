"""Settings from a TOML file over defaults."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What holds where a file says nothing.
DEFAULTS = {
    "memory.max_memory": "1GB",
    "memory.eviction_policy": "allkeys-lfu",
    "persistence.aof_enabled": False,
    "persistence.aof_fsync": "everysec",
    "persistence.aof_filename": "appendonly.aof",
    "logging.level": "info",
}


def load(path: str | Path | None = None) -> dict[str, object]:
    """``section.name`` -> value: the defaults, and over them what the file says. A missing
    file gives the defaults; a broken one raises."""
    out = dict(DEFAULTS)
    if path is not None and Path(path).exists():
        with open(path, "rb") as f:
            for section, values in tomllib.load(f).items():
                out |= {f"{section}.{name}": value for name, value in values.items()} if isinstance(values, dict) else {section: values}
    return out


def table(spark: SparkSession, settings: dict[str, object]) -> DataFrame:
    """(name, value) as text."""
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in sorted(settings.items())], "name string, value string")
