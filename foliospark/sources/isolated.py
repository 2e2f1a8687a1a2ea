"""A parser in a child process that can be killed, one child for each worker.

The child gets contents over a pipe and answers with blocks. One that does not answer in time, whatever it
is stuck in, is killed; one that dies costs its file only. The next file gets a new child.
"""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import time

_HEAD = struct.Struct("<Q")


class NoResult(RuntimeError):
    """The child ended without an answer."""


def _send(stream, value) -> None:
    data = pickle.dumps(value, protocol=5)
    stream.write(_HEAD.pack(len(data)) + data)
    stream.flush()


class Isolated:
    """Runs a pickled parser: bytes to (page, y, x, text) blocks."""

    def __init__(self, parser: bytes):
        self.parser, self.child = parser, None

    def _start(self) -> None:
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.child = subprocess.Popen([sys.executable, "-m", "foliospark.sources.isolated"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env)
        _send(self.child.stdin, self.parser)

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.wait()
            self.child.stdin.close()
            self.child.stdout.close()
            self.child = None

    def _read(self, n: int, until: float) -> bytes:
        out, file = bytearray(), self.child.stdout.fileno()
        while len(out) < n:
            left = until - time.monotonic()
            if left <= 0 or not select.select([file], [], [], left)[0]:
                raise TimeoutError
            part = os.read(file, min(n - len(out), 1 << 20))
            if not part:
                raise NoResult("the parser's process ended without a result")
            out += part
        return bytes(out)

    def __call__(self, content: bytes, seconds: float) -> list[tuple]:
        """Blocks; raises PermissionError or ValueError as the parser said, TimeoutError, NoResult."""
        if self.child is None:
            self._start()
        try:
            until = time.monotonic() + seconds
            try:
                _send(self.child.stdin, content)
            except BrokenPipeError as e:
                raise NoResult("the parser's process ended without a result") from e
            kind, value = pickle.loads(self._read(_HEAD.unpack(self._read(_HEAD.size, until))[0], until))
        except TimeoutError:
            self.close()
            raise TimeoutError(f"no result within {seconds:g} s") from None
        except BaseException:
            self.close()
            raise
        if kind == "blocked":
            raise PermissionError(value)
        if kind == "error":
            raise ValueError(value)
        return value


def main() -> None:
    """The child: the parser first, then one answer for each content."""
    source, sink = sys.stdin.buffer, os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)  # what a parser prints must not get between the answers
    receive = lambda: pickle.loads(source.read(_HEAD.unpack(source.read(_HEAD.size))[0]))
    parser = pickle.loads(receive())
    while len(head := source.read(_HEAD.size)) == _HEAD.size:
        content = pickle.loads(source.read(_HEAD.unpack(head)[0]))
        try:
            answer = ("ok", [(int(p), float(y), float(x), str(t)) for p, y, x, t in parser(content)])
        except PermissionError as e:
            answer = ("blocked", str(e))
        except Exception as e:  # noqa: BLE001  an answer too
            answer = ("error", str(e))
        _send(sink, answer)


if __name__ == "__main__":
    main()
