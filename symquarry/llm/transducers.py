"""Small weighted finite-state transducers over token classes, and their composition.

A machine reads a clause, one token class a step; each arc writes marks and carries a weight, as a
logarithm. Machines are composed by running them side by side on the same input (the product of
their states): marks unite and weights add. The product is tabulated once.
"""

from __future__ import annotations

from collections.abc import Callable

#: Token classes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = 6
#: Marks on a token.
NEGATED, REPORTED, TARGETED, THREATENED = 1, 2, 4, 8
#: An arc: next state, marks, logarithm of the weight.
Arc = tuple[int, int, float]


class Machine:
    """States 0..n-1 from 0; ``step(state, cls) -> arc`` tabulated."""

    def __init__(self, states: int, step: Callable[[int, int], Arc]):
        self.states = states
        self.table = [[step(s, c) for c in range(CLASSES)] for s in range(states)]


def after(trigger: int, marked: tuple[int, ...], reach: int, mark: int, weight: float = 0.0) -> Machine:
    """Marks a token of ``marked`` within ``reach`` tokens after one of class ``trigger``, and weighs it."""

    def step(state: int, cls: int) -> Arc:
        hit = bool(state) and cls in marked
        return (reach if cls == trigger else max(state - 1, 0)), mark if hit else 0, weight if hit else 0.0

    return Machine(reach + 1, step)


def compose(*machines: Machine) -> list[list[Arc]]:
    """The table of the product machine: only states that can be reached from the start."""
    start = (0,) * len(machines)
    number, queue, table = {start: 0}, [start], []
    while len(table) < len(queue):
        row = []
        for cls in range(CLASSES):
            moves = [m.table[s][cls] for m, s in zip(machines, queue[len(table)])]
            to, mark = tuple(n for n, _, _ in moves), 0
            for _, m, _ in moves:
                mark |= m
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append((number[to], mark, sum(w for _, _, w in moves)))
        table.append(row)
    return table


def clause_grammar(negated: float = 0.0, reported: float = 0.0, targeted: float = 0.0, threatened: float = 0.0) -> list[list[Arc]]:
    """Insult, threat, target, negation and reported speech in one machine; arguments: logarithms of the weights.

    An insult or threat is negated up to 3 tokens after a negation, reported up to 8 after a verb of
    speech, targeted up to 5 after a person; a person up to 4 tokens after a threat completes it.
    """
    return compose(
        after(NEGATION, (INSULT, THREAT), 3, NEGATED, negated),
        after(REPORT, (INSULT, THREAT), 8, REPORTED, reported),
        after(TARGET, (INSULT, THREAT), 5, TARGETED, targeted),
        after(THREAT, (TARGET,), 4, THREATENED, threatened),
    )
