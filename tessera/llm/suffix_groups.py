"""Suffix arrays by linear grouping.

The suffixes are first put into groups that share their longest Lyndon prefix.
Groups start as the suffixes of one first symbol, dealt by counting, and are
settled from the largest down. A settled group sends each member to its previous
smaller suffix (the nearest position to the left that lies in a lower group);
what lies there is continued by the settled group's string, so it moves into a
new, higher group behind the ones that are not continued, farther up the more
copies follow it. One scan in suffix order then fills every group from its front:
a suffix that is placed places those to its left of which it is the next smaller
one. Groups are linked lists in ascending position, so nothing is compared or
sorted; names are never recomputed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order.

    ``text`` must end in a symbol that is smaller than all others and occurs
    once; the empty sequence gives the empty list.
    """
    if not text:
        return []
    group, before = _lyndon_groups(text)
    return _emit(group, before)


def _lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each suffix the first rank of its Lyndon group, and its previous smaller position (-1: none).

    A group is a linked list of its members in ascending position. Members find
    their previous smaller positions in that order, so those ascend as well, equal
    ones stand together, and nothing has to be sorted on the way.
    """
    n = len(text)
    number = [0] * (max(text) + 1)
    for x in text:
        number[x] += 1
    heads, rank = [0] * len(number), 0
    for x, c in enumerate(number):
        heads[x] = rank
        rank += c
    # by group head: members; by last rank of a group: its head
    first, last, size, closing = [-1] * n, [-1] * n, [0] * n, [0] * n
    after, ahead, group, before = [-1] * n, [-1] * n, [0] * n, [-1] * n
    for s, x in enumerate(text):
        g = group[s] = heads[x]
        if size[g]:
            t = last[g]
            after[t], ahead[s] = s, t
        else:
            first[g] = s
        last[g] = s
        size[g] += 1
    for x, c in enumerate(number):
        if c:
            closing[heads[x] + c - 1] = heads[x]

    def move(members: list[int], g: int) -> None:
        """Puts ascending members of group ``g`` into a group of their own behind the others."""
        k = len(members)
        rest = size[g] - k
        if not rest:
            return
        top = g + rest
        tail = -1
        for p in members:
            a, b = ahead[p], after[p]
            if a >= 0:
                after[a] = b
            else:
                first[g] = b
            if b >= 0:
                ahead[b] = a
            else:
                last[g] = a
            group[p], ahead[p] = top, tail
            if tail >= 0:
                after[tail] = p
            tail = p
        after[tail] = -1
        first[top], last[top], size[top], size[g] = members[0], tail, k, rest
        closing[top + k - 1], closing[top - 1] = top, g

    end = n
    while end:
        head = closing[end - 1]
        s = first[head]
        if end - head == 1:
            p = s - 1
            while p >= 0 and group[p] > head:
                p = before[p]
            before[s] = p
            end = head
            if p >= 0 and size[group[p]] > 1:
                move([p], group[p])
            continue
        by_copies: dict[int, list[int]] = {}  # positions by how many members they precede
        held, copies, most = -1, 0, 0
        while s >= 0:
            p = s - 1
            while p >= 0 and group[p] >= head:
                p = before[p]
            before[s] = p
            if p != held:
                if held >= 0:
                    by_copies.setdefault(copies, []).append(held)
                    most = max(most, copies)
                held, copies = p, 0
            copies += 1
            s = after[s]
        if held >= 0:
            by_copies.setdefault(copies, []).append(held)
            most = max(most, copies)
        end = head
        for c in range(most, 0, -1):
            of_group: dict[int, list[int]] = {}
            for p in by_copies.get(c, ()):
                of_group.setdefault(group[p], []).append(p)
            for g, members in of_group.items():
                move(members, g)
    return group, before


def _emit(group: list[int], before: list[int]) -> list[int]:
    """Suffixes in order, each placed by its next smaller suffix."""
    n = len(group)
    out = [-1] * n
    free = list(range(n))
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for rank in range(n):
        p = out[rank] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = before[p]
    return out


def joined(strings: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """One text of all strings, each closed by a separator of its own that is below every byte, and where each begins."""
    m, text, begins = len(strings), [], []
    for k, s in enumerate(strings):
        begins.append(len(text))
        text.extend([b + m for b in s])
        text.append(m - 1 - k)
    return text, begins
