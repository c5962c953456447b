"""A concatenative language that compiles to Spark columns.

Words work on a stack that exists while compiling only: its entries are columns and quotations. A word
that is neither an operator, a definition, a local nor a column's name is a number, a truth value or a text.
Choices compile both branches; MAP, FILTER, FOLD and EACH become functions of arrays.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class StackError(ValueError):
    """The program can't be compiled."""


@dataclass(frozen=True)
class Quotation:
    """Words in brackets, with what was curried in front of them and the locals they saw."""

    words: tuple
    held: tuple = ()
    names: tuple = ()


def parse(text: str) -> tuple:
    """Words, quoted as in a shell, and tuples for brackets."""
    lexer = shlex.shlex(text, posix=True, punctuation_chars="[]")
    lexer.whitespace_split, lexer.commenters = True, ""
    frames: list[list] = [[]]
    for word in lexer:
        parts = list(word) if set(word) <= {"[", "]"} else [word]
        for p in parts:
            if p == "[":
                frames.append([])
            elif p == "]":
                if len(frames) == 1:
                    raise StackError("unmatched ]")
                body = tuple(frames.pop())
                frames[-1].append(body)
            else:
                frames[-1].append(p)
    if len(frames) > 1:
        raise StackError("unmatched [")
    return tuple(frames[0])


def _whole(c: Column) -> Column:
    return c.cast("bigint")


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,  # by zero: an error, as Spark raises
    "%": lambda a, b: a % b,
    "|": lambda a, b: _whole(a).bitwiseOR(_whole(b)),
    "&": lambda a, b: _whole(a).bitwiseAND(_whole(b)),
    "^": lambda a, b: _whole(a).bitwiseXOR(_whole(b)),
    "<<": lambda a, b: F.call_function("shiftleft", _whole(a), b.cast("int")),
    ">>": lambda a, b: F.call_function("shiftright", _whole(a), b.cast("int")),
    "||": lambda a, b: a | b,
    "or": lambda a, b: a | b,
    "&&": lambda a, b: a & b,
    "and": lambda a, b: a & b,
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_UNARY: dict[str, Callable[[Column], Column]] = {"~": lambda a: F.bitwise_not(_whole(a)), "!": lambda a: ~a, "not": lambda a: ~a}
#: Each shuffle takes so many entries and leaves those at these places among them, the deepest first.
_SHUFFLES = {
    "DUP": (1, (0, 0)),
    "DROP": (1, ()),
    "SWAP": (2, (1, 0)),
    "OVER": (2, (0, 1, 0)),
    "ROT": (3, (1, 2, 0)),
    "-ROT": (3, (2, 0, 1)),
    "NIP": (2, (1,)),
    "TUCK": (2, (1, 0, 1)),
    "2DUP": (2, (0, 1, 0, 1)),
    "2DROP": (2, ()),
    "2SWAP": (4, (2, 3, 0, 1)),
    "2OVER": (4, (0, 1, 2, 3, 0, 1)),
    "2ROT": (6, (2, 3, 4, 5, 0, 1)),
}


class Machine:
    """Compiles programs over the columns named, or given by name, in `columns`; `operators` are further words, functions of the stack."""

    def __init__(self, columns: Mapping[str, Column] | Iterable[str] = (), operators: Mapping[str, Callable[[list], None]] | None = None):
        self.columns = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
        self.operators = dict(operators or {})
        self.definitions: dict[str, Quotation] = {}

    def load(self, text: str) -> None:
        """Takes definitions: `[ body ] :name`."""
        words = parse(text)
        for body, name in zip(words[::2], words[1::2], strict=True):
            if not isinstance(body, tuple) or not isinstance(name, str) or not name.startswith(":"):
                raise StackError("a definition is [ body ] :name")
            self.definitions[name[1:]] = Quotation(body)

    def run(self, program: str | tuple, stack: list | None = None) -> list:
        out = list(stack or [])
        self._words(parse(program) if isinstance(program, str) else program, out, {}, 0)
        return out

    def column(self, program: str | tuple) -> Column:
        """The one column that a program leaves."""
        out = self.run(program)
        if len(out) != 1 or isinstance(out[0], Quotation):
            raise StackError(f"the program leaves {len(out)} entries, not one column")
        return out[0]

    def _take(self, stack: list, n: int) -> list:
        if len(stack) < n:
            raise StackError(f"{n} entries needed, {len(stack)} there")
        out = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return out

    def _quotation(self, q) -> Quotation:
        if not isinstance(q, Quotation):
            raise StackError("a quotation is needed")
        return q

    def call(self, q, stack: list, depth: int = 0) -> None:
        q = self._quotation(q)
        if depth > 200:
            raise StackError("definitions nest too deeply")
        stack.extend(q.held)
        self._words(q.words, stack, dict(q.names), depth + 1)

    def _words(self, words: tuple, stack: list, names: dict, depth: int) -> None:
        for w in words:
            if isinstance(w, tuple):
                stack.append(Quotation(w, (), tuple(names.items())))
            elif w.startswith(">") and len(w) > 1 and (w[1].isalpha() or w[1] == "_"):
                if w[1:] in names:
                    raise StackError(f"{w[1:]} is bound already")
                names[w[1:]] = self._take(stack, 1)[0]
            elif w in names:
                stack.append(names[w])
            else:
                self._word(w, stack, depth)

    def _word(self, w: str, stack: list, depth: int) -> None:
        call = lambda q, s: self.call(q, s, depth)
        if w in self.definitions:
            call(self.definitions[w], stack)
        elif w in self.operators:
            self.operators[w](stack)
        elif w in _BINARY:
            a, b = self._take(stack, 2)
            stack.append(_BINARY[w](a, b))
        elif w in _UNARY:
            stack.append(_UNARY[w](self._take(stack, 1)[0]))
        elif w in _SHUFFLES:
            n, places = _SHUFFLES[w]
            taken = self._take(stack, n)
            stack.extend(taken[p] for p in places)
        elif w == "CALL":
            call(self._take(stack, 1)[0], stack)
        elif w in ("DIP", "2DIP", "3DIP", "KEEP", "2KEEP", "3KEEP"):
            n = int(w[0]) if w[0].isdigit() else 1
            q = self._take(stack, 1)[0]
            kept = self._take(stack, n)
            if w.endswith("KEEP"):
                stack.extend(kept)
            call(q, stack)
            stack.extend(kept)
        elif w in ("BI", "TRI"):
            quotes = self._take(stack, 2 if w == "BI" else 3)
            value = self._take(stack, 1)[0]
            for q in quotes:
                stack.append(value)
                call(q, stack)
        elif w in ("BI*", "TRI*", "BI@", "TRI@"):
            n = 2 if w.startswith("BI") else 3
            quotes = self._take(stack, n) if w.endswith("*") else self._take(stack, 1) * n
            values = self._take(stack, n)
            for v, q in zip(values, quotes, strict=True):
                stack.append(v)
                call(q, stack)
        elif w == "COMPOSE":
            a, b = map(self._quotation, self._take(stack, 2))
            stack.append(Quotation(("CALL", "__second", "CALL"), (a,), (("__second", b),)))
        elif w in ("CURRY", "2CURRY", "3CURRY"):
            n = int(w[0]) if w[0].isdigit() else 1
            *values, q = self._take(stack, n + 1)
            q = self._quotation(q)
            stack.append(Quotation(q.words, (*values, *q.held), q.names))
        elif w in ("IF", "WHEN", "UNLESS"):
            branches = self._take(stack, 2 if w == "IF" else 1)
            condition = self._take(stack, 1)[0]
            sides = []
            for q in (branches if w == "IF" else [branches[0], None] if w == "WHEN" else [None, branches[0]]):
                side = list(stack)
                if q is not None:
                    call(q, side)
                sides.append(side)
            if len(sides[0]) != len(sides[1]):
                raise StackError(f"the branches of {w} leave different numbers of entries")
            stack[:] = [a if a is b else F.when(condition, a).otherwise(b) for a, b in zip(*sides, strict=True)]
        elif w in ("MAP", "FILTER"):
            seq, q = self._take(stack, 2)
            stack.append((F.transform if w == "MAP" else F.filter)(seq, lambda x: self._apply(q, [x], depth)))
        elif w == "FOLD":
            seq, first, q = self._take(stack, 3)
            stack.append(F.aggregate(seq, first, lambda acc, x: self._apply(q, [acc, x], depth)))
        elif w == "EACH":
            seq, q = self._take(stack, 2)
            n = len(stack)
            pack = lambda s: F.struct(*[c.alias(f"s{i}") for i, c in enumerate(s)])

            def step(state: Column, x: Column) -> Column:
                inner = [state[f"s{i}"] for i in range(n)] + [x]
                call(q, inner)
                if len(inner) != n:
                    raise StackError("EACH must leave the stack as high as it was")
                return pack(inner)

            if n:
                end = F.aggregate(seq, pack(stack), step)
                stack[:] = [end[f"s{i}"] for i in range(n)]
        elif w in self.columns:
            stack.append(self.columns[w])
        else:
            stack.append(_literal(w))

    def _apply(self, q, args: list, depth: int) -> Column:
        inner = list(args)
        self.call(q, inner, depth)
        if len(inner) != 1:
            raise StackError("the quotation must leave one result")
        return inner[0]


def _literal(w: str) -> Column:
    if w in ("true", "false"):
        return F.lit(w == "true")
    try:
        return F.lit(float(w))
    except ValueError:
        return F.lit(w)


class Rewriter:
    """Rules `pattern -> replacement` over words, applied one at a time, first rule and first place first, until nothing changes.

    `$x` stands for one word or bracket, `$*xs` for any number; a name that comes twice must stand for the
    same. A program that comes up again ends the rewriting, as does the budget of backtracking.
    """

    def __init__(self, max_backtracks: int = 100_000):
        self.rules: list[tuple[tuple, tuple]] = []
        self.max_backtracks = max_backtracks

    def add_rule(self, pattern: str, replacement: str) -> None:
        p, r = parse(pattern), parse(replacement)
        if not p:
            raise StackError("a pattern can't be empty")
        if missing := _variables(r) - _variables(p):
            raise StackError(f"the replacement uses {', '.join(sorted(missing))}, which the pattern lacks")
        self.rules.append((p, r))

    def optimize(self, words: str | tuple) -> tuple:
        current = parse(words) if isinstance(words, str) else words
        seen = {current}
        while (following := self._once(current)) is not None and following not in seen:
            seen.add(following)
            current = following
        return current

    def _once(self, words: tuple) -> tuple | None:
        for pattern, replacement in self.rules:
            for at in range(len(words)):
                self._budget = self.max_backtracks
                if found := self._match(pattern, words[at:], {}):
                    bound, used = found
                    return words[:at] + _fill(replacement, bound) + words[at + used :]
        for i, w in enumerate(words):
            if isinstance(w, tuple) and (inner := self._once(w)) is not None:
                return words[:i] + (inner,) + words[i + 1 :]
        return None

    def _match(self, pattern: tuple, words: tuple, bound: dict, whole: bool = False) -> tuple[dict, int] | None:
        self._budget -= 1
        if self._budget < 0:
            return None
        if not pattern:
            return None if whole and words else (bound, 0)
        p, rest = pattern[0], pattern[1:]
        if isinstance(p, str) and p.startswith("$*"):
            for n in range(len(words), -1, -1):
                if bound.get(p, words[:n]) == words[:n] and (found := self._match(rest, words[n:], bound | {p: words[:n]}, whole)):
                    return found[0], found[1] + n
            return None
        if not words:
            return None
        w = words[0]
        if isinstance(p, str) and p.startswith("$"):
            if bound.get(p, w) != w:
                return None
            bound = bound | {p: w}
        elif isinstance(p, tuple):
            if not isinstance(w, tuple) or not (inner := self._match(p, w, bound, True)):
                return None
            bound = inner[0]
        elif p != w:
            return None
        found = self._match(rest, words[1:], bound, whole)
        return (found[0], found[1] + 1) if found else None


def _variables(words: tuple) -> set[str]:
    return {v for w in words for v in (_variables(w) if isinstance(w, tuple) else {w} if w.startswith("$") else set())}


def _fill(words: tuple, bound: dict) -> tuple:
    out: list = []
    for w in words:
        if isinstance(w, tuple):
            out.append(_fill(w, bound))
        elif w.startswith("$*"):
            out.extend(bound[w])
        else:
            out.append(bound.get(w, w))
    return tuple(out)
