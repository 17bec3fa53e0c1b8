"""Sequential best-fit decreasing over length classes: what the distributed sweeps are held against."""

import bisect


def plan_sweeps(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit over length classes: [(length, first rank, past-last rank, first sequence, offset)] and the number of sequences.

    ``gaps[g]`` lists runs of sequences [first, past last) that have ``g`` ids
    free; a gap's offset is ``capacity - g``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of the gaps that exist, ascending
    plan, opened = [], 0

    def add(gap: int, first: int, last: int) -> None:
        if gap and first < last:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, last))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                fit = min(capacity // length, total - rank)
                new = -(-(total - rank) // fit) if fit else 0
                add(capacity, opened, opened + new)
                opened += new
                continue
            gap = sizes[at]
            first, last = gaps[gap].pop()
            take = min(last - first, total - rank)
            if take < last - first:
                gaps[gap].append((first + take, last))
            elif not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            plan.append((length, rank, rank + take, first, capacity - gap))
            rank += take
            add(gap - length, first, first + take)
    return plan, opened
