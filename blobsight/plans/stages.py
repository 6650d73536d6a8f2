"""The registry of stages: a topic's events in, events of the next topics out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from blobsight.streaming.jobs import run_stage

# Stages, what they take and give.
TOPOLOGY = (
    ("triage", ("firmware.uploaded",), ("firmware.triaged", "firmware.dlq")),
    ("unpack", ("firmware.triaged",), ("firmware.extracted", "firmware.dlq")),
    ("analysis", ("firmware.extracted",), ("firmware.analyzed",)),
    ("match", ("firmware.analyzed",), ("firmware.matched",)),
    ("aggregate", ("firmware.matched",), ("firmware.completed",)),
)


@dataclass
class Stage:
    topic: str
    transform: Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}

    def register(self, topic: str):
        def add(f: Callable[[DataFrame], DataFrame]):
            if topic in self.stages:
                raise ValueError(f"{topic} has a stage already")
            self.stages[topic] = Stage(topic, f)
            return f

        return add

    def run(self, topic: str, messages: DataFrame, out: str, dead: str, checkpoint: str):
        """The stage of ``topic`` as a streaming query over its messages; results and dead letters go to two tables."""
        return run_stage(messages, topic, self.stages[topic].transform, out, dead, checkpoint)

    def missing(self, services: list[str]) -> list[str]:
        return [t for t in subscriptions(services) if t not in self.stages]


def subscriptions(services: list[str]) -> list[str]:
    """Topics that the named stages take, once each, in the order of the flow."""
    unknown = set(services) - {name for name, _, _ in TOPOLOGY}
    if unknown:
        raise ValueError(f"unknown services: {sorted(unknown)}")
    return list(dict.fromkeys(t for name, takes, _ in TOPOLOGY if name in services for t in takes))
