"""Retention policies of versioned keys: versions = n, ttl_micros = n, any(...), all(...)."""

from __future__ import annotations

import re
from dataclasses import dataclass


class PolicyError(ValueError):
    """The text isn't a policy."""


@dataclass(frozen=True)
class Versions:
    number: int


@dataclass(frozen=True)
class Ttl:
    micros: int


@dataclass(frozen=True)
class AnyOf:
    of: tuple


@dataclass(frozen=True)
class AllOf:
    of: tuple


def parse(text: str):
    """Numbers must be positive; lists may end in a comma."""
    tokens = re.findall(r"[A-Za-z_]+|\d+|[=(),]|\S", text) + [""]
    i = 0

    def take(*wanted: str) -> str:
        nonlocal i
        got = tokens[i]
        if wanted and got not in wanted:
            raise PolicyError(f"expected {' or '.join(wanted)}, found {got or 'the end'}")
        i += 1
        return got

    def policy():
        word = take("versions", "ttl_micros", "any", "all")
        if word in ("any", "all"):
            take("(")
            parts = [policy()]
            while take(",", ")") == ",":
                if tokens[i] == ")":
                    take(")")
                    break
                parts.append(policy())
            return (AnyOf if word == "any" else AllOf)(tuple(parts))
        take("=")
        number = take()
        if not number.isdigit() or int(number) == 0:
            raise PolicyError(f"{word} needs a positive number, found {number or 'the end'}")
        return Versions(int(number)) if word == "versions" else Ttl(int(number))

    out = policy()
    if tokens[i]:
        raise PolicyError(f"unexpected {tokens[i]}")
    return out
