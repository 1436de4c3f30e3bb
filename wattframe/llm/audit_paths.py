"""Cheapest edits of a sequence of turns, and the least audit among the cheapest.

A node of the graph is a place between two turns and a state of the pattern
``(s?(ua)+)?``; an arc is an edit. After the costs are known, only arcs that some
cheapest way takes are left. These arcs are ranked by the first letter of the audit that
starts with them, then by the first two, four, eight letters and so on: the rank of the
arc and the rank of the arc that many letters on make the next rank, and the pointer to
that arc is doubled. An edit's letter fixes where it leads, so the least audit of each
length ends in one arc. The least path is read by the doubled pointers.

Many sequences are worked on at once, place by place from their ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Letters of the edits in ASCII order: delete, insert, keep, rerole.
LETTERS = np.frombuffer(b"DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE = range(4)
DELETE_COST, EDIT_COST, TRUNCATED_COST = 4, 3, 3
FAR = 1 << 40

# States: nothing yet, after s, after u, after a. Roles by initial: s, u, a, others.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_DEAD = 4
_KEPT = np.array([[AFTER_S, _DEAD, _DEAD, _DEAD], [AFTER_U, AFTER_U, _DEAD, AFTER_U], [_DEAD, _DEAD, AFTER_A, _DEAD], [_DEAD] * 4])
#: The state after the only one of user and assistant that may come next.
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
ACCEPTED = np.array([0, FAR, FAR, 0])


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs of states from which turns may be inserted first; a third would lead back."""
    return np.minimum(costs, np.minimum(EDIT_COST + costs[..., NEXT], 2 * EDIT_COST + costs[..., NEXT[NEXT]]))


FINAL = with_inserts(ACCEPTED)


@dataclass(frozen=True)
class Turns:
    """Sequences of turns one after another.

    ``role`` is the state-machine's letter of each turn (0 to 3), ``gone`` whether it
    has to be deleted, ``extra`` what every other edit of it costs more; ``starts``
    holds where the sequences begin, and the end.
    """

    role: np.ndarray
    gone: np.ndarray
    extra: np.ndarray
    starts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places before the turns, and places at the ends."""
        lengths = self.lengths
        return np.arange(len(self.role)) + np.repeat(np.arange(len(lengths)), lengths), self.starts[1:] + np.arange(len(lengths))


def costs_to_end(turns: Turns, exits: np.ndarray) -> np.ndarray:
    """Cost from every place and state to the end, by sequence and kind of exit.

    ``exits`` has the cost of each state at the end, as (sequence, kind, state).
    """
    lengths, starts = turns.lengths, turns.starts[:-1]
    _, ends = turns.nodes()
    costs = np.full((len(turns.role) + len(lengths), *exits.shape[1:]), FAR, np.int64)
    costs[ends] = exits
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    after = exits[order]
    for back, n in enumerate(active, 1):
        own = order[:n]
        at = starts[own] + lengths[own] - back
        after = after[:n]
        unless_gone = np.where(turns.gone[at], FAR, turns.extra[at])[:, None, None]
        dead = np.concatenate((after, np.full((*after.shape[:-1], 1), FAR)), axis=-1)
        kept = np.take_along_axis(dead, np.broadcast_to(_KEPT[turns.role[at]][:, None, :], after.shape), axis=-1)
        edited = np.minimum(kept, after[..., NEXT] + EDIT_COST) + unless_gone
        after = np.minimum(with_inserts(np.minimum(edited, after + DELETE_COST)), FAR)
        costs[at + own] = after
    return costs


@dataclass(frozen=True)
class Paths:
    """The least cheapest path of each sequence; edits of all one after another."""

    letter: np.ndarray
    turn: np.ndarray
    state: np.ndarray
    starts: np.ndarray
    exit_state: np.ndarray
    cost: np.ndarray


def least_paths(turns: Turns, costs: np.ndarray, entry: np.ndarray, final: np.ndarray) -> Paths:
    """From the state ``entry`` of each sequence; ``final`` ones may end with inserts.

    ``costs`` are those to the end by place and state. A sequence whose entry leads to
    no end has no edits.
    """
    places, ends = turns.nodes()
    n_places = len(costs)
    # every arc as (place, state, letter), if some cheapest way takes it
    target_state = np.zeros((n_places, 4, 4), np.int64)
    tight = np.zeros((n_places, 4, 4), bool)
    before = costs[places][:, :, None]
    after = np.concatenate((costs[places + 1], np.full((len(places), 1), FAR)), axis=1)
    unless_gone = np.where(turns.gone, FAR, turns.extra)[:, None]
    kept = _KEPT[turns.role]
    target_state[:, :, DELETE] = np.arange(4)
    target_state[:, :, INSERT] = target_state[:, :, REROLE] = NEXT
    target_state[places, :, KEEP] = np.minimum(kept, AFTER_A)
    choices = np.stack(
        (
            after[:, :4] + DELETE_COST,
            costs[places][:, NEXT] + EDIT_COST,
            np.take_along_axis(after, kept, axis=1) + unless_gone,
            after[:, NEXT] + EDIT_COST + unless_gone,
        ),
        axis=2,
    )
    tight[places] = (choices == before) & (before < FAR)
    tight[ends, :, INSERT] = (costs[ends] == costs[ends][:, NEXT] + EDIT_COST) & (costs[ends] < FAR) & final[:, None]

    arc_place, arc_state, letter = np.nonzero(tight)
    n_arcs = len(letter)
    to_place = arc_place + (letter != INSERT)
    to_state = target_state[arc_place, arc_state, letter]
    first = np.searchsorted(arc_place * 4 + arc_state, np.arange(n_places * 4 + 1))

    def least(place: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The arc of least rank out of each node; ``n_arcs`` where the path ends."""
        node = place * 4 + state
        out = first[node][:, None] + np.arange(4)
        there = out < first[node + 1][:, None]
        found = np.where(there, rank[np.where(there, out, n_arcs)], FAR)
        best = found.argmin(axis=1)
        return np.where(there.any(axis=1), out[np.arange(len(node)), best], n_arcs)

    # no letter at all comes before every letter
    rank = np.append(letter + 1, 0)
    jump = np.append(least(to_place, to_state, rank), n_arcs)
    jumps = [jump]
    while (jump != n_arcs).any():
        rank = np.unique(rank * (n_arcs + 5) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
        jumps.append(jump)

    start = least(turns.starts[:-1] + np.arange(len(entry)), entry, rank)
    steps, at = np.zeros(len(entry), np.int64), start
    for k in range(len(jumps) - 1, -1, -1):
        ahead = jumps[k][at]
        steps = np.where(ahead != n_arcs, steps + (1 << k), steps)
        at = np.where(ahead != n_arcs, ahead, at)
    some = start != n_arcs
    steps = np.where(some, steps + 1, 0)
    starts = np.concatenate(([0], np.cumsum(steps)))
    step = np.arange(starts[-1]) - np.repeat(starts[:-1], steps)
    path = np.repeat(start, steps)
    for k, pointers in enumerate(jumps):
        path = np.where(step >> k & 1, pointers[path], path)

    offset = np.repeat(np.arange(len(entry)), turns.lengths + 1)
    begin = turns.starts[:-1] + np.arange(len(entry))
    last = np.where(some, np.minimum(at, max(n_arcs - 1, 0)), 0)
    exit_state = np.where(some, to_state[last], entry) if n_arcs else entry
    reached = np.where(costs[begin, entry] < FAR, exit_state, -1)
    return Paths(
        letter[path],
        arc_place[path] - offset[arc_place[path]],
        to_state[path],
        starts,
        reached,
        costs[begin, entry] - costs[ends, exit_state],
    )
