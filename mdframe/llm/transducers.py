"""Weighted finite-state transducers: composition, best paths and all paths.

Every arc reads one symbol and writes one or none. Weights of a path add up, its final state's included, and of two paths the heavier is better.
"""

from __future__ import annotations

from collections.abc import Iterator

#: An arc that writes nothing.
NONE = ""


class Transducer:
    """States, arcs ``(state, symbol) -> [(written, weight, next state)]``, a start, and the weights of final states."""

    def __init__(self, start, arcs: dict, finals: dict) -> None:
        self.start, self.arcs, self.finals = start, arcs, finals

    @classmethod
    def of(cls, start, arcs: list[tuple], finals) -> Transducer:
        """From rows ``(state, symbol, written, weight, next state)``; ``finals`` is a mapping or states of weight 0."""
        table: dict = {}
        for state, symbol, written, weight, to in arcs:
            table.setdefault(state, {}).setdefault(symbol, []).append((written, weight, to))
        return cls(start, table, dict(finals) if isinstance(finals, dict) else dict.fromkeys(finals, 0.0))

    def step(self, state, symbol) -> list[tuple]:
        return self.arcs.get(state, {}).get(symbol, [])

    def states(self) -> set:
        return {self.start, *self.arcs, *(to for by in self.arcs.values() for out in by.values() for _, _, to in out)}

    def trimmed(self) -> Transducer:
        """Without states from which no final state is reached."""
        before: dict = {}
        for state, by in self.arcs.items():
            for out in by.values():
                for _, _, to in out:
                    before.setdefault(to, set()).add(state)
        alive, todo = set(self.finals), list(self.finals)
        while todo:
            for state in before.get(todo.pop(), ()):
                if state not in alive:
                    alive.add(state)
                    todo.append(state)
        arcs = {}
        for state in alive & set(self.arcs):
            kept = {symbol: [a for a in out if a[2] in alive] for symbol, out in self.arcs[state].items()}
            arcs[state] = {symbol: out for symbol, out in kept.items() if out}
        return Transducer(self.start, arcs, self.finals)

    def paths(self, symbols) -> Iterator[tuple[float, tuple]]:
        """Weight and writing of every path that reads ``symbols`` and ends in a final state."""
        def walk(state, k, weight, written):
            if k == len(symbols):
                if state in self.finals:
                    yield weight + self.finals[state], tuple(written)
                return
            for out, w, to in self.step(state, symbols[k]):
                yield from walk(to, k + 1, weight + w, [*written, out] if out != NONE else written)

        yield from walk(self.start, 0, 0.0, [])

    def best(self, symbols) -> tuple[float, tuple] | None:
        """The heaviest path, of ties the one with the least writing; None if there is no path. One pass, one path kept a state."""
        now = {self.start: (0.0, ())}
        for symbol in symbols:
            after: dict = {}
            for state, (weight, written) in now.items():
                for out, w, to in self.step(state, symbol):
                    path = (weight + w, (*written, out) if out != NONE else written)
                    known = after.get(to)
                    if known is None or (-path[0], path[1]) < (-known[0], known[1]):
                        after[to] = path
            now = after
        ends = [(weight + self.finals[state], written) for state, (weight, written) in now.items() if state in self.finals]
        return min(ends, key=lambda p: (-p[0], p[1])) if ends else None


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads like ``first`` and writes what ``second`` makes of that; weights add up."""
    start = (first.start, second.start)
    arcs: dict = {}
    finals: dict = {}
    todo, seen = [start], {start}
    while todo:
        state = todo.pop()
        p, q = state
        if p in first.finals and q in second.finals:
            finals[state] = first.finals[p] + second.finals[q]
        for symbol, out in first.arcs.get(p, {}).items():
            for written, w, to in out:
                met = [(NONE, 0.0, q)] if written == NONE else second.step(q, written)
                for written2, w2, to2 in met:
                    arcs.setdefault(state, {}).setdefault(symbol, []).append((written2, w + w2, (to, to2)))
                    if (to, to2) not in seen:
                        seen.add((to, to2))
                        todo.append((to, to2))
    return Transducer(start, arcs, finals).trimmed()
