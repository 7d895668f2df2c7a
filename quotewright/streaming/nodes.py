"""Micro-batches as a Fenwick tree: node n stands for the last lowbit(n) batches up to n, so any first n batches are at
most log2(n) + 1 nodes."""

from __future__ import annotations

from collections.abc import Iterator


def nodes(n: int, above: int = 0) -> Iterator[int]:
    """The nodes that stand for the batches ``above`` + 1 to ``n``, latest first."""
    while n > above:
        yield n
        n -= n & -n


def inner(n: int) -> Iterator[int]:
    """The nodes that make up node ``n`` together with batch ``n``."""
    return nodes(n - 1, n - (n & -n))
