"""Deterministic weighted finite-state transducers over small alphabets, and the clause grammar built from five of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

Arc = tuple[str, float, object]  # output, weight, next state


@dataclass
class Transducer:
    """``step(state, symbol)`` gives the output, the weight and the next state of the one arc for the symbol."""

    start: object
    step: Callable[[object, str], Arc]

    def compose(self, other: Transducer) -> Transducer:
        """Feed the outputs of this transducer into the other; weights add up."""
        def step(state, symbol: str) -> Arc:
            mine, weight, here = self.step(state[0], symbol)
            out, more, there = other.step(state[1], mine)
            return out, weight + more, (here, there)

        return Transducer((self.start, other.start), step)

    def compiled(self, alphabet: Iterable[str]) -> dict[object, dict[str, Arc]]:
        """Arcs of all states that can be reached."""
        table, open_states = {}, [self.start]
        while open_states:
            state = open_states.pop()
            if state not in table:
                table[state] = {symbol: self.step(state, symbol) for symbol in alphabet}
                open_states += [arc[2] for arc in table[state].values()]
        return table


#: Input symbols: insult, threat, target, negation, reporting verb, end of a sentence's part, any other word.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "T", "Y", "N", "R", "o"
ALPHABET = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
#: Words over which a negation or a target reaches.
NEGATION_REACH, TARGET_REACH = 3, 4


def reported_speech(weight: float = 0.0) -> Transducer:
    """After a reporting verb, insults and threats of the clause are somebody else's words (mark r)."""
    def step(reported: bool, symbol: str) -> Arc:
        if symbol == REPORT:
            return OTHER, 0.0, True
        hit = symbol in (INSULT, THREAT)
        return (symbol + "r", weight, reported) if hit and reported else (symbol, 0.0, reported)

    return Transducer(False, step)


def negation(weight: float = 0.0) -> Transducer:
    """A negation marks the insult or threat within the next words (mark n)."""
    def step(left: int, symbol: str) -> Arc:
        if symbol == NEGATION:
            return OTHER, 0.0, NEGATION_REACH
        hit = symbol[0] in (INSULT, THREAT)
        return (symbol + "n", weight, 0) if hit and left else (symbol, 0.0, max(0, left - 1))

    return Transducer(0, step)


def target(weight: float = 0.0) -> Transducer:
    """A person addressed shortly before an insult or threat makes it directed (mark t)."""
    def step(left: int, symbol: str) -> Arc:
        if symbol == TARGET:
            return TARGET, 0.0, TARGET_REACH
        hit = symbol[0] in (INSULT, THREAT)
        return (symbol + "t", weight, left) if hit and left else (symbol, 0.0, max(0, left - 1))

    return Transducer(0, step)


def insult(weight: float = 0.0) -> Transducer:
    """An insult counts wherever it stands."""
    def step(state: int, symbol: str) -> Arc:
        return (symbol, weight if symbol[0] == INSULT else 0.0, 0)

    return Transducer(0, step)


def threat(weight: float = 0.0, marks: dict[str, float] | None = None) -> Transducer:
    """A threatening verb counts with a target before it or within the next words; alone it is an ordinary word.

    A verb that waits for its target keeps its marks; ``marks`` has the weights that they, and the target, add then.
    """
    extra = marks or {}

    def step(state: tuple[int, str], symbol: str) -> Arc:
        left, waiting = state
        if symbol[0] == THREAT:
            return (symbol, weight, (0, "")) if "t" in symbol else (OTHER, 0.0, (TARGET_REACH, symbol[1:]))
        if symbol == TARGET and left:
            return THREAT + waiting + "t", weight + sum(extra.get(m, 0.0) for m in waiting + "t"), (0, "")
        return (OTHER if symbol == TARGET else symbol), 0.0, (left - 1, waiting) if left > 1 else (0, "")

    return Transducer((0, ""), step)


def clause_grammar(weights: dict[str, float]) -> tuple[object, dict[object, dict[str, Arc]]]:
    """Start state and arcs of the five transducers, composed; weights by name."""
    of = lambda name: weights.get(name, 0.0)
    marks = {"r": of("reported_speech"), "n": of("negation"), "t": of("target")}
    whole = reported_speech(marks["r"])
    for part in (negation(marks["n"]), target(marks["t"]), insult(of("insult")), threat(of("threat"), marks)):
        whole = whole.compose(part)
    return whole.start, whole.compiled(ALPHABET)


def match(grammar: tuple[object, dict[object, dict[str, Arc]]], symbols: list[str]) -> list[tuple[int, str, float]]:
    """(place, marked hit, weight) of the clause's path."""
    state, arcs = grammar
    found = []
    for place, symbol in enumerate(symbols):
        out, weight, state = arcs[state][symbol]
        if out[0] in (INSULT, THREAT):
            found.append((place, out, weight))
    return found
