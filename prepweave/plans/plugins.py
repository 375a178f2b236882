"""A registry of named capabilities: connectors, processors, validators and exporters as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from prepweave.errors import PlanError

KINDS = ("connector", "processor", "validator", "exporter")


@dataclass
class Registry:
    entries: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, work: Callable) -> None:
        if kind not in KINDS:
            raise PlanError("CAPABILITY_KIND_UNSUPPORTED", kind)
        if (kind, name) in self.entries:
            raise PlanError("CAPABILITY_DUPLICATE", f"{kind} {name}")
        self.entries[kind, name] = work

    def get(self, kind: str, name: str) -> Callable:
        if (kind, name) not in self.entries:
            raise PlanError("CAPABILITY_NOT_FOUND", f"{kind} {name}")
        return self.entries[kind, name]

    def process(self, name: str, df: DataFrame, **config) -> DataFrame:
        return df.transform(self.get("processor", name), **config)
