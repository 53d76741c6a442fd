"""Cheapest repairs of role sequences, by the auction algorithm for shortest paths.

Rows pass through an automaton of the roles that stand so far: nothing (E), a system row
(S), a user row last (U), an assistant row last (A). A lattice node is (rows read, state).
From each node a row can be deleted, kept or given the role that must follow, or a row with
that role inserted before it; all costs are whole numbers.

The auction keeps a price per node that never exceeds an arc's cost plus the price at the
arc's end, and a path from the origin along arcs where both are equal. The path is extended
along such an arc, or the price at its end is raised and the path contracted by that node.
When the path reaches the sink, the origin's price is its distance, and every arc of every
cheapest path is tight; walking tight arcs by the least letter gives the first of them.

Many lattices of at most `SEGMENT` rows run side by side in numpy arrays. Longer sequences are
cut into segments; the prices at the start of one are the exit prices of the one before.
"""

from __future__ import annotations

import numpy as np

#: Rows of one lattice.
SEGMENT = 16
STATES = "ESUA"
#: Initials of roles, by kind; 0 is any other.
KINDS = " sua"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: Arcs in the order of their letters.
LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: No path costs as much within a segment.
FAR = 1 << 40
#: Prices after the last row, and what is inserted there.
END_PRICES = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
END_LETTERS = (b"", b"II", b"I", b"")

_E, _S, _U, _A = range(4)
#: State after a kept row of each kind; -1 where the row cannot stand.
_KEPT = np.array([[-1, _S, _U, -1], [-1, -1, _U, -1], [-1, -1, -1, _A], [-1, -1, _U, -1]])
#: State after the row that must follow: a user row, or an assistant row after a user row.
_NEXT = np.array([_U, _U, _A, _U])
_NODES = 4 * (SEGMENT + 1)
_SINK = _NODES


class Lattices:
    """Lattices of equal form, one for each row of `kinds`, `faults` (n, SEGMENT) and `sizes`.

    `exits` (n, 4) are the prices after the last row of each; `FAR` where a state may not be
    left there. `entry_prices` has the distance from each state before the first row.
    """

    def __init__(self, kinds: np.ndarray, faults: np.ndarray, sizes: np.ndarray, exits: np.ndarray):
        n = len(sizes)
        self.sizes = sizes
        rows = np.arange(SEGMENT)[None, :] < sizes[:, None]
        standing = rows & ((faults == NO_FAULT) | (faults == TRUNCATED))
        extra = np.where(faults == TRUNCATED, CUT_SHORT, 0)
        cost = np.full((n, SEGMENT + 1, 4, 4), FAR, np.int64)
        head = np.full((n, SEGMENT + 1, 4, 4), _SINK, np.int64)
        place = 4 * np.arange(SEGMENT)
        for q in range(4):
            cost[:, :SEGMENT, q, 0] = np.where(rows, DELETE, FAR)
            head[:, :SEGMENT, q, 0] = place + 4 + q
            cost[:, :SEGMENT, q, 1] = np.where(rows, INSERT, FAR)
            head[:, :SEGMENT, q, 1] = place + _NEXT[q]
            kept = _KEPT[q][kinds]
            cost[:, :SEGMENT, q, 2] = np.where(standing & (kept >= 0), KEEP + extra, FAR)
            head[:, :SEGMENT, q, 2] = place + 4 + np.maximum(kept, 0)
            cost[:, :SEGMENT, q, 3] = np.where(standing, REROLE + extra, FAR)
            head[:, :SEGMENT, q, 3] = place + 4 + _NEXT[q]
        self.base = exits.min(axis=1)
        exits = np.where(exits < FAR, exits - self.base[:, None], FAR)
        each = np.arange(n)
        cost[each, sizes, :, 0] = exits
        head[each, sizes, :, 0] = _SINK
        self.cost, self.head = cost.reshape(n, _NODES, 4), head.reshape(n, _NODES, 4)
        self.price = np.zeros((n, _NODES + 1), np.int64)
        self.price[:, :_NODES][~self._leads_on(self.cost < FAR)] = FAR
        for origin in range(4):
            self._auction(origin)

    @property
    def entry_prices(self) -> np.ndarray:
        prices = self.price[:, :4]
        return np.where(prices < FAR, prices + self.base[:, None], FAR)

    def _leads_on(self, arcs: np.ndarray) -> np.ndarray:
        """Nodes from which the given arcs lead to the sink."""
        n = len(arcs)
        leads = np.zeros((n, _NODES + 1), bool)
        leads[:, _SINK] = True
        each = np.arange(n)[:, None]
        for row in range(SEGMENT, -1, -1):
            nodes = np.arange(4 * row, 4 * row + 4)
            for arc in (0, 2, 3, 1, 1):  # insertions stay in their row, so they come last, twice
                leads[:, nodes] |= arcs[:, nodes, arc] & leads[each, self.head[:, nodes, arc]]
        return leads[:, :_NODES]

    def _auction(self, origin: int) -> None:
        """Raise prices until the path from this state reaches the sink, in all lattices."""
        open_ = np.flatnonzero(self.price[:, origin] < FAR)
        path = np.zeros((len(self.sizes), _NODES + 1), np.int64)
        path[:, 0] = origin
        depth = np.zeros(len(self.sizes), np.int64)
        while len(open_):
            at = path[open_, depth[open_]]
            value = self.cost[open_, at] + self.price[open_[:, None], self.head[open_, at]]
            arc = value.argmin(axis=1)
            best = value[np.arange(len(open_)), arc]
            raised = self.price[open_, at] < best
            up = open_[raised]
            self.price[up, at[raised]] = best[raised]
            depth[up] = np.maximum(depth[up] - 1, 0)
            on, to = open_[~raised], self.head[open_, at, arc][~raised]
            depth[on] += 1
            path[on, depth[on]] = to
            arrived = np.zeros(len(self.sizes), bool)
            arrived[on[to == _SINK]] = True
            open_ = open_[~arrived[open_]]

    def traces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each entry state: letters (n, 4, most) filled up with 0, exit state, and cost of the first cheapest path.

        The exit state is -1 where no path leads on.
        """
        n = len(self.sizes)
        tight = (self.cost < FAR) & (
            self.price[:, :_NODES, None] == self.cost + self.price[np.arange(n)[:, None, None], self.head]
        )
        leads = np.concatenate([self._leads_on(tight), np.ones((n, 1), bool)], axis=1)
        tight &= leads[np.arange(n)[:, None, None], self.head]
        which, node = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
        known = self.price[which, node] < FAR
        last = 4 * self.sizes[which]
        columns, cost = [], np.zeros(4 * n, np.int64)
        walking = known & (node < last)
        while walking.any():
            w, at = which[walking], node[walking]
            arc = tight[w, at].argmax(axis=1)
            letter = np.zeros(4 * n, np.uint8)
            letter[walking] = LETTERS[arc]
            columns.append(letter)
            cost[walking] += self.cost[w, at, arc]
            node[walking] = self.head[w, at, arc]
            walking = known & (node < last)
        letters = np.stack(columns, axis=1) if columns else np.zeros((4 * n, 0), np.uint8)
        exits = np.where(known, node - last, -1)
        return letters.reshape(n, 4, -1), exits.reshape(n, 4), cost.reshape(n, 4)


def _segments(sequences: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    """Numbers of the sequences that have a segment `k`, and their rows there."""
    with_k = [i for i, (kinds, _) in enumerate(sequences) if len(kinds) > SEGMENT * k]
    kinds, faults = np.zeros((2, len(with_k), SEGMENT), np.int64)
    sizes = np.zeros(len(with_k), np.int64)
    for row, i in enumerate(with_k):
        part = [a[SEGMENT * k : SEGMENT * (k + 1)] for a in sequences[i]]
        sizes[row] = len(part[0])
        kinds[row, : sizes[row]], faults[row, : sizes[row]] = part
    return np.array(with_k, np.int64), kinds, faults, sizes


def distances(sequences: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(n, 4, 4): the cost from each state before the rows to each after them; `FAR` for none.

    A sequence is the kinds and the faults of its rows, at least one.
    """
    found = np.full((len(sequences), 4, 4), FAR, np.int64)
    for leave in range(4):
        exits = np.full((len(sequences), 4), FAR, np.int64)
        exits[:, leave] = 0
        for _, which, solved in _backward(sequences, exits):
            exits[which] = solved.entry_prices
        found[:, :, leave] = exits
    return found


def _backward(sequences: list[tuple[np.ndarray, np.ndarray]], exits: np.ndarray):
    """Segments solved from the last to the first; `exits` must be renewed between two of them."""
    most = max((len(kinds) for kinds, _ in sequences), default=0)
    for k in range(-(-most // SEGMENT) - 1, -1, -1):
        which, *rows = _segments(sequences, k)
        yield k, which, Lattices(*rows, exits[which])


def repairs(
    sequences: list[tuple[np.ndarray, np.ndarray]], exits: np.ndarray
) -> list[list[tuple[bytes, int, int] | None]]:
    """For each sequence and entry state, the edits' letters, the exit state and the cost up to it.

    The cheapest edits under the exit prices; of equally cheap ones, those whose letters
    are least. None where no edits lead on.
    """
    exits = exits.copy()
    pieces: list[dict] = [{} for _ in sequences]
    for k, which, solved in _backward(sequences, exits):
        exits[which] = solved.entry_prices
        letters, leave, cost = solved.traces()
        for row, i in enumerate(which.tolist()):
            pieces[i][k] = (letters[row], leave[row].tolist(), cost[row].tolist())
    done = []
    for parts in pieces:
        done.append([_joined(parts, q) for q in range(4)])
    return done


def _joined(parts: dict, state: int) -> tuple[bytes, int, int] | None:
    text, total = [], 0
    for k in range(len(parts)):
        letters, leave, cost = parts[k]
        if leave[state] < 0:
            return None
        text.append(letters[state].tobytes().rstrip(b"\0"))
        total += cost[state]
        state = leave[state]
    return b"".join(text), state, total
