"""Settings of an application, from Spark's configuration, with defaults and range checks."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Prefix of the settings in Spark's configuration: ``spark.lodestone.max_file_size`` and so on.
PREFIX = "spark.lodestone."


@dataclass
class Settings:
    """What an application may set; every value has a default."""

    storage_path: str = "lodestone-data"
    max_tokens: int = 4096
    temperature: float = 0.3
    max_file_size: int = 1 << 20
    concurrent_files: int = 1
    max_functions: int = 20
    response_tokens: int = 2000
    log_level: str = "INFO"

    def validate(self) -> Settings:
        """Raise ValueError for values out of range; a number of files at once that isn't positive becomes one."""
        if not self.storage_path:
            raise ValueError("storage_path is empty")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if not 0 <= self.temperature <= 1:
            raise ValueError("temperature must lie between 0 and 1")
        if self.max_file_size <= 0:
            raise ValueError("max_file_size must be positive")
        self.concurrent_files = max(1, self.concurrent_files)
        return self


def settings(spark: SparkSession) -> Settings:
    """Settings of a session, checked; the package's logger takes the level set."""
    out = Settings()
    for f in fields(Settings):
        given = spark.conf.get(PREFIX + f.name, None)
        if given is not None:
            setattr(out, f.name, type(getattr(out, f.name))(given))
    logging.getLogger(__package__).setLevel(out.log_level)
    return out.validate()
