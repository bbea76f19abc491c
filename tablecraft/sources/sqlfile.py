"""Reports in SQL files with a header of directives, run with named parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ArgumentError


@dataclass(frozen=True)
class SqlReport:
    """``-- name:``, ``-- param: name type`` and ``-- column: name type`` lines above a statement."""

    name: str
    sql: str
    params: tuple[tuple[str, str], ...] = ()
    columns: tuple[tuple[str, str], ...] = ()

    def run(self, spark: SparkSession, **values: Any) -> DataFrame:
        declared = {n for n, _ in self.params}
        if declared != set(values):
            raise ArgumentError(f"{self.name}: parameters {sorted(declared ^ set(values))} are missing or unknown")
        df = spark.sql(self.sql, args=values)
        if not self.columns:
            return df
        if [c.lower() for c in df.columns] != [n.lower() for n, _ in self.columns]:
            raise ArgumentError(f"{self.name}: the statement gives {df.columns}")
        return df.select(*[df[n].cast(t).alias(n) for n, t in self.columns])


def parse_report(text: str) -> SqlReport:
    name, params, columns, body = "", [], [], []
    for line in text.splitlines():
        if m := re.match(r"--\s*(name|param|column)\s*:\s*(\S+)\s*(\S*)", line):
            if m[1] == "name":
                name = m[2]
            elif not m[3]:
                raise ArgumentError(f"{m[1]} {m[2]} needs a type")
            else:
                (params if m[1] == "param" else columns).append((m[2], m[3]))
        else:
            body.append(line)
    if not name:
        raise ArgumentError("a report needs a name")
    return SqlReport(name, "\n".join(body).strip().rstrip(";"), tuple(params), tuple(columns))


__all__ = ["SqlReport", "parse_report"]
