"""Memory and CPU of a process tree, read from /proc, and a recorder that samples a command while it runs."""

from __future__ import annotations

import os
import subprocess
import threading
import time
from dataclasses import dataclass
from pathlib import Path

_TICK = os.sysconf("SC_CLK_TCK") if hasattr(os, "sysconf") else 100
_PAGE = os.sysconf("SC_PAGE_SIZE") if hasattr(os, "sysconf") else 4096


@dataclass
class Sample:
    """One row of the resource series: bytes and percent of all cores, by kind of process."""

    ts: float
    main_mem: int = 0
    main_cpu: float = 0.0
    java_mem: int = 0
    java_cpu: float = 0.0
    workers_mem: int = 0
    workers_cpu: float = 0.0

    def row(self) -> tuple:
        return (self.ts, self.main_mem, self.main_cpu, self.java_mem, self.java_cpu, self.workers_mem, self.workers_cpu)


def _stat(pid: int) -> tuple[int, str, float, int] | None:
    """Parent, command name, CPU seconds and resident bytes; None if the process is gone."""
    try:
        text = Path(f"/proc/{pid}/stat").read_text()
    except OSError:
        return None
    name, rest = text[text.index("(") + 1 : text.rindex(")")], text[text.rindex(")") + 2 :].split()
    return int(rest[1]), name, (int(rest[11]) + int(rest[12])) / _TICK, int(rest[21]) * _PAGE


def tree(pid: int) -> dict[int, tuple[str, float, int]]:
    """name, CPU seconds and resident bytes of a process and all below it."""
    stats = {int(p): s for p in os.listdir("/proc") if p.isdigit() and (s := _stat(int(p)))}
    found, todo = {}, [pid]
    while todo:
        now = todo.pop()
        if now in stats:
            found[now] = stats[now][1:]
        todo += [p for p, s in stats.items() if s[0] == now and p not in found]
    return found


def sample(pid: int, wait: float = 0.1) -> Sample:
    """The tree's use over `wait` seconds. All java processes count together; zeros if the process is gone."""
    before, began = tree(pid), time.time()
    time.sleep(wait)
    after, took = tree(pid), max(1e-9, time.time() - began)
    out = Sample(time.time())
    for p, (name, cpu, memory) in after.items():
        kind = "main" if p == pid else "java" if "java" in name else "workers"
        used = max(0.0, cpu - before.get(p, (name, cpu, 0))[1]) / took * 100 / (os.cpu_count() or 1)
        setattr(out, f"{kind}_mem", getattr(out, f"{kind}_mem") + memory)
        setattr(out, f"{kind}_cpu", getattr(out, f"{kind}_cpu") + used)
    return out


class Recorder:
    """Samples a process in a thread of its own: with Recorder(pid) as r: ...; r.samples."""

    def __init__(self, pid: int, every: float = 0.3):
        self.pid, self.every, self.samples = pid, every, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.every):
            self.samples.append(sample(self.pid))

    def __enter__(self) -> Recorder:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()


def launched(command: list[str], every: float = 0.3) -> tuple[int, list[Sample]]:
    """Runs a command and samples it: its exit code and the samples. An interrupt ends the command too."""
    run = subprocess.Popen(command)
    with Recorder(run.pid, every) as recorder:
        try:
            code = run.wait()
        except KeyboardInterrupt:
            run.terminate()
            code = run.wait()
    return code, recorder.samples
