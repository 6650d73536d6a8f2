"""Leases on the shared file system: one owner of a name at a time, for a time.

A name has a folder of numbered turns. A turn is a file that only one claimant can create; it holds its owner's token and
the time it ends. The next turn may be taken once the last one is over or given back, so of two that find it over only one
succeeds, and what an owner gives back is only ever its own turn.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from blobsight.scratch import files

#: Seconds that a turn lasts.
SECONDS = 30.0


def publish(spark: SparkSession, path: str, body: bytes) -> bool:
    """Give a file that isn't there yet its name and its whole content in one step; False if it is there. The file system
    decides between two writers at the same time."""
    fs, at = files(spark, path)
    fs.mkdirs(at.getParent())
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    out = fs.create(files(spark, aside)[1], False)
    out.write(bytearray(body))
    out.close()
    if fs.makeQualified(at).toUri().getScheme() == "file":  # where a rename would replace what is there
        source, target = (files(spark, p)[1].toUri().getPath() for p in (aside, path))
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(files(spark, aside)[1], False)
    if not fs.exists(at) and fs.rename(files(spark, aside)[1], at):
        return True
    fs.delete(files(spark, aside)[1], False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = files(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass(frozen=True)
class Lease:
    name: str
    turn: int
    token: str
    until: float


class Leases:
    """Leases of one application, in ``folder``. ``clock`` gives seconds, alike for all claimants."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.clock = spark, folder.rstrip("/"), seconds, clock

    def _last(self, name: str) -> tuple[int, bool]:
        """The last turn, -1 for none, and whether it still runs."""
        fs, at = files(self.spark, f"{self.folder}/{name}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        turns = [int(x) for x in names if x.isdigit()]
        if not turns:
            return -1, False
        last = max(turns)
        if f"{last}.back" in names:
            return last, False
        return last, self.clock() < json.loads(read_text(self.spark, f"{self.folder}/{name}/{last}"))["until"]

    def _take(self, name: str, turn: int) -> Lease | None:
        lease = Lease(name, turn, uuid.uuid4().hex, self.clock() + self.seconds)
        body = json.dumps({"token": lease.token, "until": lease.until}).encode()
        return lease if publish(self.spark, f"{self.folder}/{name}/{turn}", body) else None

    def acquire(self, name: str) -> Lease | None:
        """The lease, or None where another one holds it."""
        last, runs = self._last(name)
        return None if runs else self._take(name, last + 1)

    def renew(self, lease: Lease) -> Lease | None:
        """The lease for another term; None where it has been taken over meanwhile."""
        last, runs = self._last(lease.name)
        return self._take(lease.name, last + 1) if last == lease.turn and runs else None

    def release(self, lease: Lease) -> None:
        publish(self.spark, f"{self.folder}/{lease.name}/{lease.turn}.back", lease.token.encode())
        fs, _ = files(self.spark, self.folder)
        for turn in range(max(0, lease.turn - 8), lease.turn - 1):  # turns long over
            for name in (str(turn), f"{turn}.back"):
                fs.delete(files(self.spark, f"{self.folder}/{lease.name}/{name}")[1], False)
