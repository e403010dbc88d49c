"""Public vocabularies, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import os

import regex

#: How a text is cut before merging; fixed value, equal to the vocabulary's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = regex.compile(PATTERN)


def default_dir() -> str:
    """``TESSERA_TOKENIZERS``, else the installed package's folder, else /opt/tokenizers."""
    if where := os.environ.get("TESSERA_TOKENIZERS"):
        return where
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


@functools.cache
def ranks(name: str, folder: str | None = None) -> dict[bytes, int]:
    """The merge ranks of a byte-level vocabulary, kept once for each Python worker."""
    with open(os.path.join(folder or default_dir(), f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The symbols that survive all merges of ``piece``.

    The symbols form a linked list by position; a queue holds each mergeable
    neighbouring pair under its rank. Taking the least and linking past the
    right symbol costs O(log n), so a run of a million letters is no trouble.
    """
    n = len(piece)
    if n < 2 or piece in rank:
        return [piece] if n else []
    ends = list(range(1, n + 1))  # of the symbol that starts at i; 0: swallowed
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, end = heapq.heappop(queue)
        mid = ends[i]
        if not mid or mid >= n or ends[mid] != end:
            continue  # one of the two was merged otherwise since
        ends[i], ends[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := rank.get(piece[i : ends[end]])) is not None:
                heapq.heappush(queue, (r, i, ends[end]))
        if (j := before[i]) >= 0 and (r := rank.get(piece[j:end])) is not None:
            heapq.heappush(queue, (r, j, end))
    out, i = [], 0
    while i < n:
        out.append(piece[i : ends[i]])
        i = ends[i]
    return out
