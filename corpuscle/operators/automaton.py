"""Matching many patterns in one pass: every kind of match, over characters or bytes, whole or step by step."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

STANDARD, LEFTMOST_LONGEST, LEFTMOST_FIRST = "standard", "leftmost_longest", "leftmost_first"


class Match(NamedTuple):
    """Half-open range of symbols and the pattern's value."""

    start: int
    end: int
    value: object


class Matcher:
    """Patterns as a trie with failure links.

    Patterns are texts or bytes; offsets count their symbols. Values default to the patterns' numbers. Repeated patterns all report, in order.
    The empty pattern, if given, matches at every boundary. ``kind`` decides which questions may be asked: the
    overlapping and the plain search need ``standard``, the leftmost search one of the leftmost kinds; else ``ValueError``.
    """

    def __init__(self, patterns: Iterable[Sequence], values: Iterable | None = None, kind: str = STANDARD) -> None:
        if kind not in (STANDARD, LEFTMOST_LONGEST, LEFTMOST_FIRST):
            raise ValueError(f"unknown kind of match: {kind}")
        self.kind = kind
        self.next: list[dict] = [{}]
        self.fail = [0]
        self.own: list[list[tuple[int, object]]] = [[]]  # (length, value) that end here
        self.rank: list[int] = [-1]  # of the first pattern that ends here
        self.values, self.patterns = [], []
        given = iter(values) if values is not None else None
        for number, pattern in enumerate(patterns):
            value = number if given is None else next(given)
            self.values.append(value)
            self.patterns.append(pattern)
            state = 0
            for symbol in pattern:
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.own.append([])
                    self.rank.append(-1)
                state = self.next[state][symbol]
            if not self.own[state]:
                self.rank[state] = number
            self.own[state].append((len(pattern), value))
        self._link()

    def _link(self) -> None:
        self.fail = [0] * len(self.next)
        self.out = [0] * len(self.next)  # the nearest state on the failure path, itself included, where a pattern ends; 0: none but the root's
        self.depth = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        for s in waiting:
            self.depth[s] = 1
            self.out[s] = s if self.own[s] else 0
        while waiting:
            s = waiting.popleft()
            for symbol, t in self.next[s].items():
                f = self.fail[s]
                while f and symbol not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(symbol, 0)
                self.depth[t] = self.depth[s] + 1
                self.out[t] = t if self.own[t] else self.out[self.fail[t]]
                waiting.append(t)

    def step(self, state: int, symbol) -> int:
        """The state after one more symbol."""
        while state and symbol not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(symbol, 0)

    def ending(self, state: int) -> Iterator[tuple[int, object]]:
        """(length, value) of all patterns that end in a state, longest first."""
        s = self.out[state]
        while s:
            yield from self.own[s]
            s = self.out[self.fail[s]]
        yield from self.own[0]

    def _needs(self, *kinds: str) -> None:
        if self.kind not in kinds:
            raise ValueError(f"this search needs the kind {' or '.join(kinds)}, not {self.kind}")

    def find_overlapping(self, symbols: Iterable) -> Iterator[Match]:
        """All occurrences, by end, then longest first."""
        self._needs(STANDARD)
        yield from (Match(0, 0, v) for _, v in self.own[0])
        state = 0
        for end, symbol in enumerate(symbols, 1):
            state = self.step(state, symbol)
            yield from (Match(end - n, end, v) for n, v in self.ending(state))

    def find_longest_per_end(self, symbols: Iterable) -> Iterator[Match]:
        """Of all occurrences the longest at each end."""
        self._needs(STANDARD)
        last = -1
        for m in self.find_overlapping(symbols):
            if m.end != last:
                last = m.end
                yield m

    def find(self, symbols: Iterable) -> Iterator[Match]:
        """Occurrences that don't overlap: the one that ends first wins, the longest of those, and the search goes on after it.

        An empty pattern always ends first, so with one all occurrences are empty.
        """
        self._needs(STANDARD)
        state = 0
        if self.own[0]:
            yield Match(0, 0, self.own[0][0][1])
        for end, symbol in enumerate(symbols, 1):
            state = 0 if self.own[0] else self.step(state, symbol)
            for n, v in self.ending(state):
                yield Match(end - n, end, v)
                state = 0
                break

    def find_leftmost(self, symbols: Sequence) -> Iterator[Match]:
        """Occurrences that don't overlap: the one that starts first wins, of those the longest or the one given first, as the kind says.

        An empty occurrence right after another one is left out.
        """
        self._needs(LEFTMOST_LONGEST, LEFTMOST_FIRST)
        yield from self._with_empty(symbols) if self.own[0] else self._leftmost(symbols)

    def _leftmost(self, symbols: Sequence) -> Iterator[Match]:
        """One walk over the text: an occurrence is certain once no prefix under way begins as early; the walk goes on behind it."""
        at, n, state, best = 0, len(symbols), 0, None
        while at < n or best:
            if at < n:
                state = self.step(state, symbols[at])
                at += 1
                if s := self.out[state]:
                    start = at - self.depth[s]
                    if best is None or start < best[0] or start == best[0] and (self.kind == LEFTMOST_LONGEST or self.rank[s] < self.rank[best[2]]):
                        best = (start, at, s)
            if best and (at >= n or at - self.depth[state] > best[0]):
                yield Match(best[0], best[1], self.own[best[2]][0][1])
                at, state, best = best[1], 0, None

    def _with_empty(self, symbols: Sequence) -> Iterator[Match]:
        """The same where the empty pattern, which matches everywhere, is among them."""
        start, n, closed = 0, len(symbols), -1
        while start <= n:
            state, best = 0, (0, self.own[0], self.rank[0])
            for end in range(start, n):
                state = self.next[state].get(symbols[end])
                if state is None:
                    break
                if self.own[state] and (self.kind == LEFTMOST_LONGEST or self.rank[state] < best[2]):
                    best = (end + 1 - start, self.own[state], self.rank[state])
            if best[0] or start != closed:
                yield Match(start, start + best[0], best[1][0][1])
            start += max(1, best[0])
            closed = start if best[0] else -1

    def stepper(self) -> Stepper:
        """A search that is fed symbol by symbol."""
        self._needs(STANDARD)
        return Stepper(self)

    def find_stepper(self) -> FindStepper:
        """The plain search fed symbol by symbol: occurrences that don't overlap."""
        self._needs(STANDARD)
        return FindStepper(self)

    def describe(self) -> dict[str, object]:
        """Kind, patterns, states, edges, and bytes when saved."""
        return {"kind": self.kind, "patterns": len(self.values), "states": len(self.next), "edges": sum(map(len, self.next)), "bytes": len(self.save())}

    def save(self) -> bytes:
        """Kind, patterns (texts, or lists of symbols) and values as JSON; values must be what JSON can say."""
        patterns = [p if isinstance(p, str) else {"symbols": list(p), "bytes": isinstance(p, (bytes, bytearray))} for p in self.patterns]
        return json.dumps({"kind": self.kind, "patterns": patterns, "values": self.values}).encode()

    @classmethod
    def load(cls, data: bytes) -> Matcher:
        """A saved matcher, built anew from its patterns, so that no data can make it lead astray; ``ValueError`` if it is damaged."""
        try:
            said = json.loads(data)
            patterns = [p if isinstance(p, str) else bytes(p["symbols"]) if p["bytes"] else p["symbols"] for p in said["patterns"]]
            if len(patterns) != len(said["values"]):
                raise ValueError("as many values as patterns are needed")
            return cls(patterns, said["values"], said["kind"])
        except (ValueError, KeyError, TypeError, UnicodeDecodeError) as e:
            raise ValueError(f"damaged matcher: {e}") from e


class Stepper:
    """Overlapping search over a text that arrives in pieces."""

    def __init__(self, matcher: Matcher) -> None:
        self.matcher, self.state, self.end = matcher, 0, 0

    def consume(self, symbol) -> None:
        self.state = self.matcher.step(self.state, symbol)
        self.end += 1

    def matches(self) -> list[Match]:
        """Occurrences that end where the text now ends."""
        return [Match(self.end - n, self.end, v) for n, v in self.matcher.ending(self.state)]


class FindStepper(Stepper):
    """Plain search over a text that arrives in pieces: after an occurrence the search begins anew, so ask after every symbol."""

    def matches(self) -> list[Match]:
        found = super().matches()[:1]
        if found:
            self.state = 0
        return found


def find(matcher: Matcher, symbols: Sequence, how: str) -> Iterator[Match]:
    """``overlapping``, ``longest_per_end``, ``standard`` or ``leftmost`` search by name."""
    searches = {"overlapping": matcher.find_overlapping, "longest_per_end": matcher.find_longest_per_end, "standard": matcher.find, "leftmost": matcher.find_leftmost}
    return searches[how](symbols)
