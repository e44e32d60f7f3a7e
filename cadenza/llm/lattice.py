"""Merge vocabularies as automata over prefixes.

A merge tokenizer gives every prefix of a string exactly one last token: the
vocabulary suffix ``t`` of the prefix whose left neighbour, the last token of
what precedes ``t``, stays apart from ``t`` when the two are merged alone (two
tokens stay side by side in a whole string if and only if they do so alone).
So the tokens of a prefix follow from the last tokens at the positions one
vocabulary word back, whatever the length of the string: a finite state, of
which only the part that the data visits is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


class Bounded(dict):
    """Memo of a function; emptied when full, so its memory is bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(Bounded):
    """Memo that forgets by halves: when the younger half is full it becomes the
    older one, and what is asked for again moves back.  Frequent keys stay."""

    def __init__(self, make: Callable, most: int):
        super().__init__(make, most)
        self.older: dict = {}

    def __missing__(self, key):
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def merged(parts: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Applies merges to a short list of symbols: least rank first, leftmost of equals."""
    parts = list(parts)
    while len(parts) > 1:
        best = None
        for i in range(len(parts) - 1):
            r = rank(parts[i], parts[i + 1])
            if r is not None and (best is None or r < best[0]):
                best = r, i
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Lattice:
    """``vocabulary``: the tokens; ``rank``: of a pair to merge, or None;
    ``symbols``: cuts a string into its smallest tokens.

    Tokens are numbered from 1 in the order given; 0 stands for the start of a
    string and for a sign outside the vocabulary, which never merges."""

    def __init__(self, vocabulary: Iterable[str], rank: Callable[[str, str], float | None], symbols: Callable[[str], list[str]] = list, memo: int = 250_000):
        self.names = ["", *vocabulary]
        self.rank, self.symbols = rank, symbols
        self.number = {t: k for k, t in enumerate(self.names) if k}
        self.size = [1, *map(len, self.names[1:])]
        self.longest = max(self.size)
        self.base = len(self.names)
        self.apart = Bounded(self._pair, memo)  # key: left * base + right
        self.fallen = Bounded(self._fall, memo)  # key: state, sign
        self.made: dict[str, tuple | None] = {}  # of tokens, so bounded by the vocabulary
        # automaton over all tokens: steps of a state, where a mismatch falls back to, tokens that end in it (longest first)
        self.steps: list[dict[str, int]] = [{}]
        self.falls, self.outs = [0], [()]
        for t, k in self.number.items():
            state = 0
            for c in t:
                after = self.steps[state].get(c)
                if after is None:
                    after = self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    self.falls.append(0)
                    self.outs.append(())
                state = after
            self.outs[state] = (k,)
        self.signs = frozenset(c for t in self.number for c in t)
        level = list(self.steps[0].values())
        while level:
            below = []
            for state in level:
                self.outs[state] += self.outs[self.falls[state]]
                for c, after in self.steps[state].items():
                    fall = self.falls[state]
                    while fall and c not in self.steps[fall]:
                        fall = self.falls[fall]
                    self.falls[after] = self.steps[fall].get(c, 0)
                    below.append(after)
            level = below

    def step(self, state: int, sign: str) -> int:
        """The state after one more sign; found fall-backs are kept in a bounded memo."""
        after = self.steps[state].get(sign)
        if after is None:
            after = self.fallen[state, sign] if sign in self.signs else 0
        return after

    def _fall(self, key: tuple[int, str]) -> int:
        state, sign = key
        while state and sign not in self.steps[state]:
            state = self.falls[state]
        return self.steps[state].get(sign, 0)

    def _made(self, token: str) -> tuple[float, str, str] | None:
        """Rank and halves of the merge that completes a token on its own;
        rank -1 for a symbol, None where ranks do not rise on the way."""
        if token in self.made:
            return self.made[token]
        parts, last, split = self.symbols(token), -1.0, ("", "")
        rising = True
        while len(parts) > 1:
            options = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not options:
                break
            r, i = min(options)
            rising &= r > last
            last, split = r, (parts[i], parts[i + 1])
            parts[i : i + 2] = ["".join(split)]
        whole = len(parts) == 1 and rising and all(self._made(h) is not None for h in split if h)
        out = self.made[token] = (last, *split) if whole else None
        return out

    def _pair(self, key: int) -> bool:
        """Do two tokens stay apart?  Their last merges are taken back in turn;
        a pair at the border that merges earlier than both do would have merged."""
        left, right = (self.names[k] for k in divmod(key, self.base))
        a, b = self._made(left) if left else (-1.0, "", ""), self._made(right)
        if a is None or b is None or not left:
            return merged(self.symbols(left + right), self.rank) == ([left, right] if left else [right])
        limit, strict = float("inf"), True
        while True:
            r = self.rank(left, right)
            if r is not None and (r < limit or not strict and r == limit):
                return False
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                limit, strict, left = a[0], True, a[2]
                a = self._made(left)
            else:
                limit, strict, right = b[0], False, b[1]
                b = self._made(right)

    def grow(self, text: str, ends: list[int], at: int, state: int = 0) -> int:
        """Adds the last tokens of the prefixes of ``text`` from length
        ``len(ends)`` to ``at``; ends[i] is the last token at i.  Takes and
        returns the automaton's state."""
        steps, outs, apart, base, size, fallen, signs = self.steps, self.outs, self.apart, self.base, self.size, self.fallen, self.signs
        i = len(ends)
        for sign in text[i - 1 : at]:
            after = steps[state].get(sign)
            if after is None:
                after = fallen[state, sign] if sign in signs else 0
            state = after
            for t in outs[state]:
                if apart[ends[i - size[t]] * base + t]:
                    ends.append(t)
                    break
            else:
                ends.append(0)
            i += 1
        return state

    def whole(self, text: str) -> int:
        """Number of a string that is one token, else 0."""
        k = self.number.get(text, 0)
        return k if k and self.apart[k] else 0

    def numbers(self, text: str) -> list[int]:
        """Tokens of a short string."""
        one = self.whole(text)
        if one:
            return [one]
        ends = [0]
        self.grow(text, ends, len(text))
        out, at = [], len(text)
        while at:
            out.append(ends[at])
            at -= self.size[ends[at]]
        return out[::-1]

    def closing(self, text: str, ends: list[int], mark: str, state: int) -> int:
        """The last token of ``text`` when ``mark`` ends it; ``state`` is that after all but the last sign."""
        for t in self.outs[self.step(self.step(state, text[-1]), mark)]:
            if self.apart[ends[len(text) + 1 - self.size[t]] * self.base + t]:
                return t
        raise KeyError(text)

    def spelled(self, text: str, numbers: Iterable[int]) -> Iterator[str]:
        """The tokens as strings; ``text`` gives the signs without a number."""
        at = 0
        for k in numbers:
            yield text[at : at + self.size[k]]
            at += self.size[k]


class Stream:
    """Viterbi over a text that arrives in pieces.

    Per position there is one surviving path; its backpointer is the length of
    the last token.  Only positions one longest token back can still be
    extended, so paths of that window are followed back until they meet:
    everything before the meeting boundary is final and is handed out."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.text, self.ends, self.state, self.commits = "", [0], 0, 0

    def feed(self, more: str) -> Iterator[int]:
        step = 8 * self.lattice.longest
        for at in range(0, len(more), step):
            self.text += more[at : at + step]
            self.state = self.lattice.grow(self.text, self.ends, len(self.text), self.state)
            if len(self.text) > 2 * step:
                yield from self._commit()

    def _path(self, at: int) -> list[int]:
        out = [at]
        while at:
            at -= self.lattice.size[self.ends[at]]
            out.append(at)
        return out

    def _commit(self) -> Iterator[int]:
        top = len(self.text)
        met = set(self._path(top))
        for at in range(max(0, top - self.lattice.longest + 1), top):
            met &= set(self._path(at))
        boundary = max(met)
        if not boundary:
            return
        self.commits += 1
        yield from (self.ends[i] for i in sorted(self._path(boundary))[1:])
        self.text, self.ends = self.text[boundary:], self.ends[boundary:]

    def finish(self) -> list[int]:
        self.commits += 1
        out, at, ends, size = [], len(self.text), self.ends, self.lattice.size
        while at:
            out.append(ends[at])
            at -= size[ends[at]]
        out.reverse()
        self.text, self.ends, self.state = "", [0], 0
        return out
