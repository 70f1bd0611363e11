"""A memoised pipeline of steps, a timer, and program options."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Timer:
    """Elapsed times of laps, in milliseconds."""

    def __init__(self) -> None:
        self.laps: list[float] = []
        self._since: float | None = None

    def start(self) -> None:
        self._since = time.perf_counter()

    def stop(self) -> float:
        """End the lap that runs and return its time."""
        if self._since is None:
            raise RuntimeError("the timer isn't running")
        lap = 1000 * (time.perf_counter() - self._since)
        self._since = None
        self.laps.append(lap)
        return lap

    def split(self) -> float:
        lap = self.stop()
        self.start()
        return lap

    def reset(self) -> None:
        self.laps, self._since = [], None

    @property
    def total(self) -> float:
        return sum(self.laps)

    @property
    def least(self) -> float:
        return min(self.laps)

    @property
    def most(self) -> float:
        return max(self.laps)


class Step:
    """One result, made from the results of the steps in ``needs``, which are passed in that order."""

    def __init__(self, name: str, make: Callable[..., Any], needs: Sequence[Step] = ()) -> None:
        self.name, self.make, self.needs = name, make, tuple(needs)


class StepPipeline:
    """Evaluates steps on demand, each one once; DataFrames are persisted, so what several steps need is computed once."""

    def __init__(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> None:
        self.level = level
        self._done: dict[Step, Any] = {}
        self._spent: dict[Step, float] = {}

    def get(self, step: Step) -> Any:
        if step not in self._done:
            inputs = [self.get(s) for s in step.needs]
            timer = Timer()
            timer.start()
            made = step.make(*inputs)
            if isinstance(made, DataFrame):
                made = made.persist(self.level)
                made.count()
            self._spent[step] = timer.stop()
            self._done[step] = made
        return self._done[step]

    def evaluated(self, step: Step) -> bool:
        return step in self._done

    def milliseconds(self, step: Step | None = None) -> float:
        """Time of one step without the steps it needs, or of all."""
        return sum(self._spent.values()) if step is None else self._spent.get(step, 0.0)

    def reset(self) -> None:
        for made in self._done.values():
            if isinstance(made, DataFrame):
                made.unpersist()
        self._done, self._spent = {}, {}


class Options:
    """Positional and named options and flags with defaults."""

    def __init__(self, description: str = "") -> None:
        self._parser = argparse.ArgumentParser(description=description)
        self._got: argparse.Namespace | None = None

    def positional(self, name: str, help: str = "", default: Any = None, kind: type = str) -> None:
        self._parser.add_argument(name, nargs="?" if default is not None else None, default=default, type=kind, help=help)

    def named(self, name: str, help: str = "", default: Any = None, kind: type = str, implicit: Any = None) -> None:
        more = {"nargs": "?", "const": implicit} if implicit is not None else {}
        self._parser.add_argument(f"--{name}", default=default, type=kind, required=default is None, help=help, **more)

    def flag(self, name: str, help: str = "") -> None:
        self._parser.add_argument(f"--{name}", action="store_true", help=help)

    def parse(self, args: Sequence[str] | None = None) -> Options:
        self._got = self._parser.parse_args(args)
        return self

    def __getitem__(self, name: str) -> Any:
        return getattr(self._got, name.replace("-", "_"))

    def help(self) -> str:
        return self._parser.format_help()
