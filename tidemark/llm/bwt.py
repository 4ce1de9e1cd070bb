"""Burrows-Wheeler transforms of sets of strings, and their merge by iterative interleave refinement.

Each string ends in a byte END that it doesn't hold, and its rotations are sorted. A shard's transform is what stands
before each rotation in that order, STEP bytes instead of one, which takes a STEP-th of the rounds. Shards are merged
without comparing rotations again: the interleave, which says for each place of the merged order which shard comes next,
is sorted stably by the merged transform; each time this is done STEP more bytes of every rotation count, so after
`depth` / STEP rounds rotations stand in the order of their first `depth` bytes. Boundaries between neighbours that differ
are carried along, so the common prefixes come out as intervals. Where the shards hold more than 65,536 different pieces
of STEP bytes, or STEP doesn't divide `depth`, two bytes go in a round.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # no byte of UTF-8
STEP = 5
SYMBOLS = 1 << 16  # what a 16-bit symbol can tell apart; such symbols are sorted in linear time


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the STEP bytes before, as one number; place in the joint text) of all rotations of strings that differ, in sorted
    order; by doubling."""
    text = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    start, size = np.repeat(ends - sizes, sizes), np.repeat(sizes, sizes)
    at = np.arange(len(text)) - start
    longest = int(sizes.max())
    # the first seven bytes at once, then twice as many in each round
    key = np.zeros(len(text), np.int64)
    for k in range(7):
        key = key << 8 | text[start + (at + k) % size]
    step = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if step >= longest or rank[order[-1]] == len(text) - 1:
            before = np.zeros(len(text), np.int64)
            for k in range(STEP, 0, -1):
                before = before << 8 | text[start + (at - k) % size]
            return before[order], order
        key = rank * len(text) + rank[start + (at + step) % size]
        step *= 2


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place in the shard's text, interval) of each place of the merged order; rotations are in one interval if
    their first `depth` bytes, an even number, are equal."""
    source = np.repeat(np.arange(len(shards), dtype=np.min_scalar_type(len(shards))), [len(b) for b, _ in shards])
    interval = np.zeros(len(source), np.int32)
    whole = np.concatenate([b for b, _ in shards])
    rounds = 0
    if depth % STEP == 0:
        found, ranks = np.unique(whole, return_inverse=True)
        if len(found) <= SYMBOLS:
            symbols, rounds = ranks.astype(np.uint16), depth // STEP
    if not rounds:
        symbols, rounds = (whole & 0xFFFF).astype(np.uint16), depth // 2
    cuts = np.cumsum([0, *(len(b) for b, _ in shards)])
    befores = [symbols[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(rounds):
        before = np.empty(len(source), np.uint16)
        for z, own in enumerate(befores):
            before[source == z] = own
        order = np.argsort(before, kind="stable")
        source, before, interval = source[order], before[order], interval[order]
        new = (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])
        interval = np.concatenate(([0], np.cumsum(new, dtype=np.int32)))
    place = np.empty(len(source), np.int64)
    for z, (_, own) in enumerate(shards):
        place[source == z] = own
    return source, place, interval
