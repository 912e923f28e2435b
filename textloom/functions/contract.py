"""Strict contracts for configurations: exact keys, types and ranges, reported all at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


class ContractError(ValueError):
    """A configuration that breaks its contract; ``faults`` lists every breach."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Rule:
    """What a value must be: one of some types, optional, within a test."""

    kinds: tuple[type, ...]
    test: Callable[[Any], bool] | None = None
    optional: bool = False
    inner: Mapping[str, Rule] | None = None
    each: Rule | None = None


def text(optional: bool = False) -> Rule:
    return Rule((str,), lambda v: bool(v.strip()), optional)


def positive(optional: bool = False) -> Rule:
    return Rule((int,), lambda v: v > 0, optional)


def share() -> Rule:
    return Rule((int, float), lambda v: 0 <= v <= 1)


def digest() -> Rule:
    return Rule((str,), lambda v: len(v) == 64 and all(c in "0123456789abcdef" for c in v))


def one_of(*values: Any) -> Rule:
    return Rule(tuple({type(v) for v in values}), lambda v: v in values)


def mapping(**inner: Rule) -> Rule:
    return Rule((dict,), inner=inner)


def listing(each: Rule, test: Callable[[list], bool] | None = None) -> Rule:
    return Rule((list, tuple), test, each=each)


def faults(value: Any, rule: Rule, at: str = "config") -> list[str]:
    """Every breach of a rule, with where it is."""
    if value is None:
        return [] if rule.optional else [f"{at}: missing"]
    if not isinstance(value, rule.kinds) or isinstance(value, bool) and bool not in rule.kinds:
        return [f"{at}: {type(value).__name__}"]
    found: list[str] = []
    if rule.inner is not None:
        found += [f"{at}.{k}: unknown" for k in sorted(value.keys() - rule.inner.keys())]
        for name, inner in rule.inner.items():
            found += faults(value.get(name), inner, f"{at}.{name}")
    if rule.each is not None:
        for i, item in enumerate(value):
            found += faults(item, rule.each, f"{at}[{i}]")
    if not found and rule.test is not None and not rule.test(value):
        found.append(f"{at}: out of range")
    return found


def check(value: Any, rule: Rule) -> None:
    """Raise with all breaches, if there is any."""
    if found := faults(value, rule):
        raise ContractError(found)


REFERENCE_SETS = listing(
    mapping(reference_id=text(), kind=text(), policy=one_of("block", "report"), match_mode=one_of("exact", "exact-and-near"), path=text(), sha256=digest()),
    lambda sets: len({s["reference_id"] for s in sets}) == len(sets),
)
CLEANING = mapping(
    least_characters=positive(), most_characters=positive(), most_bytes=positive(), replacement_share=share(), control_share=share(), visible_share=share(),
    numeric_share=share(), address_share=share(), token_characters=positive(), token_ascii_share=share(), run=positive(),
)


def complete(sets: list[dict], required: set[str]) -> bool:
    """Whether every required kind of reference is registered with a blocking policy."""
    return required <= {s["kind"] for s in sets if s["policy"] == "block"}
