"""Log files: groups, fingerprints, and which bytes of a file are still to be read."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

LONGEST_LINE = 256 * 1024
FIRST_LINE = 4096
SYNC_VERSION = 2
BUSY_BYTES, BUSY_SECONDS = 100 * 2**20, 30 * 60
#: A plain file's unread range is cut into parts of this many bytes, one task each.
PART_BYTES = 64 * 2**20
#: What reading a damaged or vanished file raises.
UNREADABLE = (OSError, EOFError, zlib.error)


@dataclass
class FileState:
    """How far a file has been read; ``position`` counts decompressed bytes."""

    path: str
    main_log_path: str
    fingerprint: str = ""
    position: int = 0
    size: int = 0
    modified: float = 0.0
    indexed: float = 0.0
    sync_version: int = SYNC_VERSION

    def json(self) -> dict:
        return asdict(self)


STATE_SCHEMA = "path string, main_log_path string, fingerprint string, position long, size long, modified double, indexed double, sync_version int"


@dataclass
class Slice:
    """Bytes of a file's content to read.  Lines that begin in [start, end) belong to it; ``whole`` is where the file's last
    whole line ends, and ``inside`` tells that ``start`` need not be the beginning of a line.  ``purge``: what was read from the
    file before is void."""

    path: str
    main_log_path: str
    fingerprint: str
    start: int
    end: int
    compressed: bool
    size: int
    modified: float
    purge: bool = False
    whole: int = -1
    inside: bool = False


def is_gzip(path: str) -> bool:
    """A ``.gz`` name (in any case) and a gzip head: anything else is read as it is."""
    if not path.lower().endswith(".gz"):
        return False
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def trailer_size(path: str) -> int:
    """What the trailer says of the content's size: its last member's, modulo 2**32.  Good for skipping a file only."""
    if os.path.getsize(path) < 18:
        return 0
    with open(path, "rb") as f:
        f.seek(-4, os.SEEK_END)
        return int.from_bytes(f.read(4), "little")


def content_size(path: str, step: int = 1 << 20) -> int:
    """The content's size, all members read to the end of the stream."""
    size = 0
    with gzip.open(path, "rb") as f:
        while data := f.read(step):
            size += len(data)
    return size


def open_log(path: str, compressed: bool):
    return gzip.open(path, "rb") if compressed else open(path, "rb")


def fingerprint(path: str, compressed: bool | None = None) -> str:
    """32 hexadecimal digits of the first line that is not empty; empty while that line is not whole."""
    compressed = is_gzip(path) if compressed is None else compressed
    with open_log(path, compressed) as f:
        data, more = f.read(FIRST_LINE).lstrip(b"\r\n"), f.read(1)
    line, newline, _ = data.partition(b"\n")
    if not line.strip() or not (newline or compressed or more):
        return ""
    return hashlib.sha256(line.rstrip(b"\r")).hexdigest()[:32]


def group_files(base: str, allowed: set[str] | None = None) -> list[str]:
    """The regular files of a group: the log and its rotated siblings."""
    found = dict.fromkeys([base, *sorted(glob.glob(glob.escape(base) + "*"))])
    stem = re.sub(r"\.log$", "", base)
    found |= dict.fromkeys(p for p in sorted(glob.glob(glob.escape(stem) + ".*.log")) if re.search(r"\.\d{1,3}\.log$", p))
    return [p for p in found if os.path.isfile(p) and is_allowed(p, base, allowed)]


def is_allowed(path: str, base: str, allowed: set[str] | None) -> bool:
    """A link may not leave its folder; with a list, the group must be on it."""
    if allowed is not None and base not in allowed:
        return False
    return os.path.dirname(os.path.realpath(path)) == os.path.realpath(os.path.dirname(path))


def _last_newline(path: str, start: int, end: int, step: int = 1 << 16) -> int:
    """The place after the last newline in [start, end), ``start`` if there is none."""
    with open(path, "rb") as f:
        at = end
        while at > start:
            begin = max(start, at - step)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return start


def needs_sync(state: FileState | None, size: int, modified: float) -> bool:
    return state is None or state.sync_version < SYNC_VERSION or (state.size, state.modified) != (size, modified)


def throttled(state: FileState | None, path: str, size: int, now: float) -> bool:
    """Whether a file alone is no reason for a round: it is large and was read lately."""
    return state is not None and size > BUSY_BYTES and not path.lower().endswith(".gz") and now - state.indexed < BUSY_SECONDS


def _planned(path: str, base: str, state: FileState | None, furthest: dict[str, int], force: bool, measure: Callable[[str], int]) -> Slice:
    info, compressed = os.stat(path), is_gzip(path)
    print_ = fingerprint(path, compressed)
    start, purge = 0, False
    if force or not print_:
        start = 0
    elif state is not None and state.fingerprint == print_ and state.sync_version >= SYNC_VERSION:
        purge = not compressed and info.st_size < state.position
        start = 0 if purge else state.position
    elif print_ in furthest:
        start = furthest[print_] if compressed else min(furthest[print_], info.st_size)
    else:
        purge = state is not None and state.sync_version < SYNC_VERSION
    if not print_:
        end = start
    elif not compressed:
        end = _last_newline(path, start, info.st_size)
    elif 0 < start < 2**32 and trailer_size(path) == start:
        # A compressed copy of just what was read needs no decompression.
        end = start
    else:
        end = max(start, measure(path))
    return Slice(path, base, print_, start, end, compressed, info.st_size, info.st_mtime, purge, end)


def plan(base: str, states: dict[str, FileState], force: bool = False, allowed: set[str] | None = None, now: float | None = None, measure: Callable[[str], int] = content_size) -> list[Slice]:
    """What to read of a group.  The same first line at the same path goes on where it stopped, unless the file is shorter now;
    at another path (a rotation) it goes on from the furthest position any path has; else it is read from the start.
    A group of which only large files changed that were read lately waits; if any other file changed, all that changed are read.
    ``measure`` gives the size of a compressed file's content.  A file that cannot be read is left out, the others stay."""
    furthest: dict[str, int] = {}
    for s in states.values():
        if s.fingerprint and s.sync_version >= SYNC_VERSION:
            furthest[s.fingerprint] = max(furthest.get(s.fingerprint, 0), s.position)
    changed, due = [], force
    for path in group_files(base, allowed):
        state = states.get(path)
        try:
            info = os.stat(path)
        except UNREADABLE:
            continue
        if force or needs_sync(state, info.st_size, info.st_mtime):
            changed.append(path)
            due = due or now is None or not throttled(state, path, info.st_size, now)
    out = []
    for path in changed if due else ():
        try:
            out.append(_planned(path, base, states.get(path), furthest, force, measure))
        except UNREADABLE:
            continue
    return out


def parts(piece: Slice, part_bytes: int = PART_BYTES) -> list[Slice]:
    """A plain file's slice as ranges of bounded size; compressed content cannot be entered in the middle."""
    if piece.end <= piece.start:
        return []
    if piece.compressed:
        return [piece]
    return [replace(piece, start=a, end=min(a + part_bytes, piece.end), inside=a > piece.start) for a in range(piece.start, piece.end, part_bytes)]


def lines(piece: Slice, step: int = 1 << 22) -> Iterator[tuple[list[bytes], list[int]]]:
    """Blocks of (lines, offsets) of a slice; blank lines and lines above ``LONGEST_LINE`` are passed over.  The last line of a
    compressed file needs no newline.  A file that was rotated meanwhile is read at its new path; one that is gone gives nothing."""
    now = where_now(piece) if piece.end > piece.start else None
    if now is None:
        return
    compressed = is_gzip(now)
    with open_log(now, compressed) as f:
        # A line that begins just at ``start`` follows a newline at start - 1.
        at = piece.start - piece.inside
        f.seek(at)
        rest, passing = b"", piece.inside
        while True:
            data = f.read(min(step, max(0, piece.whole - at - len(rest))))
            block = rest + data
            ends = not data
            cut = len(block) if ends else block.rfind(b"\n") + 1
            if not cut and len(block) > LONGEST_LINE:
                # The beginning of a line that is too long: only its end matters.
                at, rest, passing = at + len(block), b"", True
                continue
            found, begins = block[:cut].split(b"\n"), at
            if not found[-1]:
                found.pop()
            elif ends and not compressed:
                found.pop()
            texts, offsets = [], []
            for line in found:
                if passing:
                    passing = False
                elif begins < piece.end and len(line) <= LONGEST_LINE and (text := line.rstrip(b"\r")).strip():
                    texts.append(text)
                    offsets.append(begins)
                begins += len(line) + 1
            if texts:
                yield texts, offsets
            at, rest = at + cut, block[cut:]
            if ends or at >= piece.end:
                return


def state_after(piece: Slice, now: float) -> FileState:
    return FileState(piece.path, piece.main_log_path, piece.fingerprint, max(piece.start, piece.end), piece.size, piece.modified, float(now))


def still_there(piece: Slice) -> bool:
    """Whether the path still holds the file that was planned; a plain one may have grown."""
    try:
        size = os.stat(piece.path).st_size
        return (size == piece.size or (size > piece.size and not piece.compressed)) and fingerprint(piece.path, piece.compressed) == piece.fingerprint
    except UNREADABLE:
        return False


def where_now(piece: Slice) -> str | None:
    """The path that holds the planned file's content: its own, or that of a file of the group with the same first line."""
    if still_there(piece):
        return piece.path
    for path in group_files(piece.main_log_path):
        try:
            if piece.fingerprint and fingerprint(path) == piece.fingerprint:
                return path
        except UNREADABLE:
            continue
    return None
