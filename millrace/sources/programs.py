"""A user's program as a stream: input is fed while output is read, neither is ever held whole.

The program is a child process of the Spark task. A thread feeds its standard input; its output is read in
blocks, and only when the rows of the block before have been taken, so a slow reader slows the program down
instead of filling memory. What a task holds is one block, one unfinished line and the end of the
program's complaints.
"""

from __future__ import annotations

import os
import subprocess
import sys
import threading
from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

# Fixed values.
DEFAULT_SECONDS = 60.0
STARTS = {"python": (sys.executable, "-c"), "bash": ("bash", "-c")}

BLOCK = 1 << 20
COMPLAINT = 1 << 14


class ProgramError(RuntimeError):
    """The program of a source did not do its work."""


@dataclass(frozen=True)
class Program:
    """What is run on each file. ``seconds`` is how long it may take on one."""

    runtime: str
    script: str
    seconds: float = DEFAULT_SECONDS

    def __post_init__(self):
        if self.runtime not in STARTS:
            raise ValueError(f"no programs in {self.runtime!r} here, only in {' and '.join(sorted(STARTS))}")
        if not self.script:
            raise ValueError("the program of a source is empty")
        if self.seconds <= 0:
            raise ValueError("a program needs some time: timeout_seconds must be above 0")

    @classmethod
    def of(cls, setting) -> Program | None:
        """The program a node's ``preprocessing`` setting names; None unless it is enabled."""
        if not (isinstance(setting, Mapping) and setting.get("enabled")):
            return None
        text = {k: str(setting.get(k) or "").strip() for k in ("runtime", "script")}
        return cls(**text, seconds=float(setting.get("timeout_seconds") or DEFAULT_SECONDS))

    @property
    def identity(self) -> dict[str, str]:
        """What decides its output: not how long it may take."""
        return {"runtime": self.runtime, "script": self.script}

    def start(self, path: str, fed: bool) -> subprocess.Popen:
        name = [] if self.runtime == "python" else ["program"]
        return subprocess.Popen(
            [*STARTS[self.runtime], self.script, *name, path],
            stdin=subprocess.PIPE if fed else subprocess.DEVNULL,
            stdout=subprocess.PIPE,
            stderr=subprocess.PIPE,
            env=os.environ | {"INPUT_CSV": path},
            start_new_session=True,
        )


class _Feeder(threading.Thread):
    """Writes blocks to a program. If it stops reading, the rest is passed over, so that whoever gives the
    blocks can go on."""

    def __init__(self, blocks: Iterable[bytes], to):
        super().__init__(daemon=True)
        self.blocks, self.to, self.fault = blocks, to, None

    def run(self) -> None:
        closed = False
        try:
            for block in self.blocks:
                if not closed:
                    try:
                        self.to.write(block)
                    except (BrokenPipeError, ValueError):
                        closed = True
        except Exception as fault:  # noqa: BLE001 - raised again by whoever waits
            self.fault = fault
        finally:
            try:
                self.to.close()
            except OSError:
                pass


def _last_words(pipe, kept: deque) -> None:
    while block := pipe.read1(BLOCK):
        kept.append(block)
        while len(kept) > 1 and sum(map(len, kept)) - len(kept[0]) > COMPLAINT:
            kept.popleft()


def output(program: Program, path: str, blocks: Iterable[bytes] | None = None) -> Iterator[bytes]:
    """Blocks of what ``program`` writes about the file at ``path``, as it writes them.

    ``blocks`` go to its standard input. A program that fails, takes too long or writes nothing is an
    error, raised after the blocks it did write.
    """
    local = unquote(urlparse(path).path) if path.startswith("file:") else path
    child = program.start(local, blocks is not None)
    complaint: deque[bytes] = deque()
    threads = [threading.Thread(target=_last_words, args=(child.stderr, complaint), daemon=True)]
    if blocks is not None:
        threads.append(_Feeder(blocks, child.stdin))
    late = threading.Event()

    def stop() -> None:
        late.set()
        _end(child)

    clock = threading.Timer(program.seconds, stop)
    for t in (*threads, clock):
        t.start()
    wrote = False
    try:
        while block := child.stdout.read1(BLOCK):
            wrote = True
            yield block
        code = child.wait()
    finally:
        clock.cancel()
        _end(child)
        child.wait()
        for t in threads:
            t.join()
        child.stdout.close()
        child.stderr.close()
    if late.is_set():
        raise ProgramError(f"no result within {program.seconds:g} seconds (timed out): {path}")
    if code:
        words = b"".join(complaint)[-COMPLAINT:].decode("utf-8", "replace").strip()
        raise ProgramError(f"the program ended with exit code {code} on {path}: {words}")
    if fault := threads[-1].fault if blocks is not None else None:
        raise fault
    if not wrote:
        raise ProgramError(f"the program gave no output for {path}")


def _end(child: subprocess.Popen) -> None:
    """Ends the program and whatever it has started."""
    if child.poll() is None:
        try:
            os.killpg(child.pid, 9)
        except ProcessLookupError:
            pass


def lines_of(blocks: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Lines without their line feeds, at most ``most`` at a time; a last line needs no line feed."""
    rest: list[bytes] = []
    for block in blocks:
        first, *others = block.split(b"\n")
        rest.append(first)
        if others:
            whole = [b"".join(rest), *others[:-1]]
            rest = [others[-1]]
            for at in range(0, len(whole), most):
                yield whole[at : at + most]
    if last := b"".join(rest):
        yield [last]
