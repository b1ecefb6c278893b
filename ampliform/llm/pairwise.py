"""What the two tokenizer operators share: byte-pair encoding as a left-to-right machine.

A sequence of tokens is the encoding of its text exactly when each two neighbours, joined and encoded alone, give
these two tokens again: merges inside a token never look past its ends, so what happens at one boundary depends on
the two tokens beside it. Hence each prefix of a text has one last token, found from the last tokens of the prefixes
shorter by a token's length at most, and reading goes from left to right with a bounded window.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

#: The rank of a pair that doesn't merge.
NEVER = float("inf")
_WIDTH = 1 << 21


class Pairwise:
    """rank(a, b): the priority of merging two neighbouring pieces, smaller first; NEVER if they don't merge."""

    def __init__(self, pieces: set, rank: Callable):
        self.pieces, self.rank = pieces, rank
        self._runs: dict = {}
        self._pair: dict = {}

    def run(self, text) -> tuple[list, list, list]:
        """Merges the best pair first, the leftmost of equals: (pieces left, [(rank, first piece)], [(rank, last piece)] after each merge)."""
        part = [text[i : i + 1] for i in range(len(text))]
        ranks = [self.rank(a, b) for a, b in itertools.pairwise(part)]
        first, last = [], []
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank(part[i - 1], part[i])
            if i < len(ranks):
                ranks[i] = self.rank(part[i], part[i + 1])
            first.append((best, part[0]))
            last.append((best, part[-1]))
        return part, first, last

    def _run(self, piece) -> tuple[bool, list, list]:
        if (r := self._runs.get(piece)) is None:
            part, first, last = self.run(piece)
            r = self._runs[piece] = (len(part) == 1, first, last)
        return r

    def whole(self, piece) -> bool:
        """Whether the piece, encoded alone, stays whole."""
        return self._run(piece)[0]

    def fits(self, a, b) -> bool:
        """Whether b can follow a: whether no merge crosses their boundary while both are being built."""
        if (w := self._pair.get((a, b))) is None:
            if len(self._pair) > 400_000:
                self._pair.clear()
            w = self._pair[a, b] = self._apart(a, b)
        return w

    def _apart(self, a, b) -> bool:
        ours, theirs = self._run(a)[2], self._run(b)[1]
        x, y, i, j = a[-1:], b[:1], 0, 0
        while True:
            over = self.rank(x, y)
            left = ours[i][0] if i < len(ours) else NEVER
            right = theirs[j][0] if j < len(theirs) else NEVER
            if over < left and over <= right:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                x, i = ours[i][1], i + 1
            else:
                y, j = theirs[j][1], j + 1


class State(dict):
    """A state of the transducer, compiled when first met; maps the next symbol to (next state, output).

    entries: for each suffix that a piece can begin with, the empty one first: (its node in the pieces' trie, the token
    before it, weight), the weight being what the encoding up to that token has beyond what was put out.
    """

    __slots__ = ("entries", "machine")

    def __init__(self, machine: Machine, entries: tuple):
        super().__init__()
        self.machine, self.entries = machine, entries

    def __missing__(self, symbol):
        machine = self.machine
        if len(machine.known) >= machine.most_states:
            machine.forget()
        self[symbol] = move = machine.move(self.entries, symbol)
        return move


class Machine(Pairwise):
    """A deterministic transducer over symbols, compiled lazily from the pieces, in a table that is emptied when it's full.

    zero is the empty weight; add(weight, piece) extends it; settle(weights) gives (output, weights without it).
    """

    def __init__(self, pieces: set, rank: Callable, zero, add: Callable, settle: Callable, most_states: int):
        super().__init__(pieces, rank)
        self.add, self.settle, self.most_states = add, settle, most_states
        # nodes are multiples of _WIDTH, those with children first; an edge is its node plus the symbol's code
        inner = sorted({p[:i] for p in pieces for i in range(1, len(p))})
        at = {p: (i + 1) * _WIDTH for i, p in enumerate([*inner, *sorted(pieces - set(inner))])}
        code = (lambda p: p[-1]) if isinstance(next(iter(pieces)), bytes) else (lambda p: ord(p[-1]))
        self._edges = {at.get(p[:-1], 0) + code(p): node for p, node in at.items()}
        self._tokens, self._leaves = {at[p]: p for p in pieces}, (len(inner) + 1) * _WIDTH
        self.known: dict[tuple, State] = {}
        self.start = State(self, ((0, None, zero),))

    def forget(self) -> None:
        """Drops all compiled states; a run in progress goes on from the one that it holds."""
        self.known.clear()
        self.start.clear()

    def state(self, entries: tuple) -> State:
        """The state of these entries."""
        if entries == self.start.entries:
            return self.start
        if (found := self.known.get(entries)) is None:
            found = self.known[entries] = State(self, entries)
        return found

    def move(self, entries: tuple, symbol) -> tuple[State, object]:
        """The next state and the output; the one suffix whose token fits is the last token of what was read."""
        code = symbol if isinstance(symbol, int) else ord(symbol)
        edges, tokens, leaves, runs, pair = self._edges.get, self._tokens.get, self._leaves, self._runs, self._pair
        token, ways, weights = None, [None], [None]
        for node, before, weight in entries:
            if (to := edges(node + code)) is None:
                continue
            if token is None and (t := tokens(to)) is not None and (runs.get(t) or self._run(t))[0]:
                if before is None or (fits := pair.get((before, t))) or fits is None and self.fits(before, t):
                    token, weights[0] = t, self.add(weight, t)
            if to < leaves:
                ways.append((to, before))
                weights.append(weight)
        if token is None:  # a symbol that no piece has
            token, weights[0] = symbol, self.add(entries[0][2], symbol)
        put, weights = self.settle(weights)
        key = ((0, token, weights[0]), *[(w[0], w[1], x) for w, x in zip(ways[1:], weights[1:], strict=True)])
        if (state := self.known.get(key)) is None:
            state = self.known[key] = State(self, key)
        return state, put
