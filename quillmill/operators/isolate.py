"""Parsers in a child process that can be killed: limits of wall-clock time and memory for each document, also within C code."""

from __future__ import annotations

import multiprocessing
import os
import pickle
import resource
import select
import time

#: Bytes of address space that a child may take beyond what it has when it begins.
MEMORY = 2 << 30


class ParserDied(Exception):
    """The child ended without an answer: killed by the system, or a crash in C code."""


class ParseTimeout(Exception):
    """No answer within the time given."""


class Isolated:
    """Calls ``call(*args)`` in one child after the other: a child serves many documents, and a killed one is replaced.

    ``killed`` counts children that were stopped, ``leaked`` those that were still there five
    seconds after that; both may be Spark accumulators.
    """

    def __init__(self, call, *, memory: int = MEMORY, killed=None, leaked=None):
        self.call, self.memory, self.killed, self.leaked = call, memory, killed, leaked
        self.child = self.pipe = self.ready = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stop()

    def start(self) -> None:
        """Forks a child, which keeps what this process holds now as long as it lives: best before there is any data."""
        fork = multiprocessing.get_context("fork")  # the call may be a closure, which only a fork can take along
        self.pipe, theirs = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(self.call, theirs, self.pipe, self.memory), daemon=True)
        self.child.start()
        theirs.close()
        self.ready = select.poll()
        self.ready.register(self.pipe.fileno(), select.POLLIN)

    def run(self, seconds: float, *args):
        """The call's result, which is plain data; ParseTimeout after ``seconds``, ParserDied if the child has gone."""
        if self.child is None or not self.child.is_alive():
            self.stop()
            self.start()
        until = time.monotonic() + seconds if seconds > 0 else None
        try:
            self.pipe.send_bytes(pickle.dumps(args, pickle.HIGHEST_PROTOCOL))
            if not self.ready.poll(None if until is None else max(0.0, until - time.monotonic()) * 1000):
                self.stop(kill=True)
                raise ParseTimeout
            return pickle.loads(self.pipe.recv_bytes())
        except (EOFError, BrokenPipeError, ConnectionResetError) as error:
            self.stop(kill=True)
            raise ParserDied from error

    def stop(self, kill: bool = False) -> None:
        if self.child is None:
            return
        if kill:
            self.child.kill()
            if self.killed is not None:
                self.killed += 1
        self.pipe.close()
        self.child.join(5)
        if self.child.is_alive():
            self.child.kill()
            if self.leaked is not None:
                self.leaked += 1
        self.child = self.pipe = self.ready = None


def _serve(call, pipe, other, memory: int) -> None:
    other.close()  # else the parent's end stays open here, and its close is never seen
    used = int(open("/proc/self/statm").read().split()[0]) * os.sysconf("SC_PAGE_SIZE") if os.path.exists("/proc/self/statm") else 0
    if memory and used:
        resource.setrlimit(resource.RLIMIT_AS, (used + memory, resource.RLIM_INFINITY))
    while True:
        try:
            args = pickle.loads(pipe.recv_bytes())
        except (EOFError, OSError):
            os._exit(0)
        try:
            pipe.send_bytes(pickle.dumps(call(*args), pickle.HIGHEST_PROTOCOL))
        except (OSError, MemoryError):
            os._exit(1)
