"""Engine settings from `key = value` text with units."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields

from .errors import EngineError

_SIZE = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
_TIME = {"": 1, "ms": 1, "s": 1000, "min": 60_000}


@dataclass(frozen=True)
class Config:
    """How many statements run at once (0: any) and how long others wait, row cap of text results, timeout of statements, isolation of new sessions, and memory per task for planning partitions.

    ``work_mem`` becomes the advisory size of a shuffle partition; spilling itself is Spark's.
    """

    work_mem: int = 64 << 20
    statement_timeout_ms: int = 0
    max_result_rows: int | None = None
    isolation_level: str = "SNAPSHOT"
    max_concurrent_statements: int = 0
    admission_timeout_ms: int = 10_000

    @staticmethod
    def parse(text: str) -> Config:
        """Blank lines and `#` comments are skipped; unknown keys are errors."""
        out = {}
        for n, line in enumerate(text.splitlines(), 1):
            line = line.split("#")[0].strip()
            if not line:
                continue
            key, eq, value = (x.strip() for x in line.partition("="))
            if not eq or key not in {f.name for f in fields(Config)}:
                raise EngineError(f"line {n}: unknown setting '{key}'")
            if key == "isolation_level":
                out[key] = value.upper()
                if out[key] not in ("SNAPSHOT", "SERIALIZABLE"):
                    raise EngineError(f"line {n}: unknown isolation level {value}")
                continue
            m = re.fullmatch(r"(\d+)\s*([A-Za-z]*)", value)
            units = _SIZE if key == "work_mem" else _TIME if key.endswith("_timeout_ms") else {"": 1}
            if not m or m[2].lower() not in units:
                raise EngineError(f"line {n}: '{value}' is not a value of {key}")
            out[key] = int(m[1]) * units[m[2].lower()]
        return Config(**out)

    def shown(self) -> dict[str, str]:
        return {k: "" if v is None else str(v) for k, v in asdict(self).items()}

    def spark_conf(self) -> dict[str, str]:
        """What a session builder should be given to follow these settings."""
        return {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{self.work_mem}b", "spark.sql.session.timeZone": "UTC"}
