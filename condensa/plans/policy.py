"""Routing policies: strict loading and validation, on the driver.

A policy is JSON: version, tiers (cheap to capable), default, inspect, routes, signals, session, overrides. Unknown keys are
refused. check() returns (warnings, errors) as texts that start with the place they are about.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

KEEP, REQUESTED = "keep", "requested"
MAX_DEPTH, MAX_REGEX, MAX_CANDIDATES, MANY_CANDIDATES = 6, 512, 256, 32

# What a policy may say.
SCOPES = ("last_user_turn", "recent_turns", "full")
LEVELS = ("hard", "easy", "medium")
GROUPS = ("all", "any", "not")
LEAVES = ("context_tokens", "message_count", "tool_loop", "has_tools", "keywords", "keywords_regex", "requested_model", "domain", "embedding", "complexity")
ML_LEAVES = ("domain", "embedding", "complexity")
BOUNDS = ("eq", "gt", "gte", "lt", "lte")
CATEGORIES = ("biology", "business", "chemistry", "computer science", "economics", "engineering", "health", "history", "law", "math", "other", "philosophy", "physics", "psychology")
SHAPE = {
    "": {"version", "tiers", "default", "inspect", "routes", "signals", "session", "overrides"},
    "tiers": {"name", "model"}, "routes": {"name", "when", "to"}, "inspect": {"scope", "turns"}, "signals": {"domains", "embeddings", "complexity"},
    "domains": {"name", "categories", "min_mass"}, "embeddings": {"name", "threshold", "candidates"}, "complexity": {"name", "threshold", "hard", "easy"},
    "session": {"sticky", "min_band_jump"}, "overrides": {"pin_header"},
}


class PolicyError(ValueError):
    pass


@dataclass
class Policy:
    version: int = 0
    tiers: list[dict] = field(default_factory=list)
    default: str = ""
    inspect: dict = field(default_factory=dict)
    routes: list[dict] = field(default_factory=list)
    signals: dict = field(default_factory=dict)
    session: dict = field(default_factory=dict)
    overrides: dict = field(default_factory=dict)

    def rank(self, tier: str) -> int:
        return next((i for i, t in enumerate(self.tiers) if t.get("name") == tier), -1)

    def model(self, tier: str) -> str:
        return next((t.get("model", "") for t in self.tiers if t.get("name") == tier), "")

    def signal(self, kind: str, name: str) -> dict | None:
        return next((s for s in self.signals.get(kind, []) if s.get("name") == name), None)


def uses_model(rule: dict) -> bool:
    """Whether a condition consults a model signal anywhere."""
    return any(k in rule for k in ML_LEAVES) or any(uses_model(r) for r in [*rule.get("all", []), *rule.get("any", []), *([rule["not"]] if "not" in rule else [])])


def _strict(where: str, kind: str, value) -> dict:
    if not isinstance(value, dict):
        raise PolicyError(f"{where}: must be an object")
    if extra := set(value) - SHAPE[kind]:
        raise PolicyError(f"{where}: unknown key {sorted(extra)[0]!r}")
    return value


def _strict_rule(where: str, rule) -> dict:
    if not isinstance(rule, dict):
        raise PolicyError(f"{where}: must be an object")
    if extra := set(rule) - set(GROUPS) - set(LEAVES):
        raise PolicyError(f"{where}: unknown key {sorted(extra)[0]!r}")
    out = dict(rule)
    for g in ("all", "any"):
        if g in rule:
            if not isinstance(rule[g], list):
                raise PolicyError(f"{where}.{g}: must be a list")
            out[g] = [_strict_rule(f"{where}.{g}[{i}]", r) for i, r in enumerate(rule[g])]
    if "not" in rule:
        if isinstance(rule["not"], list):
            raise PolicyError(f"{where}.not: takes one condition, not a list")
        out["not"] = _strict_rule(f"{where}.not", rule["not"])
    for b in ("context_tokens", "message_count"):
        if b in rule:
            out[b] = _band(f"{where}.{b}", rule[b])
    return out


def _band(where: str, value) -> dict:
    if isinstance(value, int) and not isinstance(value, bool):
        return {"eq": value}
    if not isinstance(value, dict) or any(k not in BOUNDS for k in value) or any(not isinstance(v, int) or isinstance(v, bool) for v in value.values()):
        raise PolicyError(f"{where}: must be a whole number or bounds out of {', '.join(BOUNDS)}")
    return value


def loads(text: str) -> Policy:
    """A policy from JSON; raises PolicyError for unknown keys, wrong shapes and failed checks."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise PolicyError(f"not JSON: {e}") from e
    p = Policy(**_strict("policy", "", raw))
    for kind in ("tiers", "routes"):
        for i, x in enumerate(getattr(p, kind)):
            _strict(f"{kind}[{i}]", kind, x)
    for kind in ("inspect", "signals", "session", "overrides"):
        _strict(kind, kind, getattr(p, kind) or {})
    for kind, xs in (p.signals or {}).items():
        for i, x in enumerate(xs):
            _strict(f"signals.{kind}[{i}]", kind, x)
    p.routes = [r | {"when": _strict_rule(f"routes[{i}].when", r.get("when", {}))} for i, r in enumerate(p.routes)]
    _, errors = check(p)
    if errors:
        raise PolicyError("; ".join(errors))
    return p


def load(path: str | None) -> Policy | None:
    """The policy of a file; none (pass everything through) where there is no file."""
    return loads(Path(path).read_text()) if path and Path(path).exists() else None


def check(p: Policy) -> tuple[list[str], list[str]]:
    """(warnings, errors)."""
    found = [*_tiers(p), *_default(p), *_inspect(p), *_signals(p), *_routes(p), *_session(p)]
    return [m for bad, m in found if not bad], [m for bad, m in found if bad]


Found = Iterator[tuple[bool, str]]


def _tiers(p: Policy) -> Found:
    if p.version != 1:
        yield True, f"version: must be 1, is {p.version}"
    if not p.tiers:
        yield True, "tiers: at least one is needed"
    names = [t.get("name", "") for t in p.tiers]
    for i, t in enumerate(p.tiers):
        if not names[i]:
            yield True, f"tiers[{i}]: no name"
        elif names[i] in (KEEP, REQUESTED):
            yield True, f"tiers[{i}]: {names[i]!r} is reserved"
        elif names[i] in names[:i]:
            yield True, f"tiers[{i}]: {names[i]!r} is there already"
        if not t.get("model"):
            yield True, f"tiers[{i}]: no model"


def _default(p: Policy) -> Found:
    if not p.default:
        yield True, "default: is needed"
    elif p.default == KEEP:
        yield True, f"default: cannot be {KEEP!r}; {REQUESTED!r} keeps the client's model"
    elif p.default != REQUESTED and p.rank(p.default) < 0:
        yield True, f"default: {p.default!r} is no tier"


def _inspect(p: Policy) -> Found:
    scope = p.inspect.get("scope", "")
    if scope not in SCOPES:
        yield True, f"inspect.scope: must be one of {', '.join(SCOPES)}"
    elif scope == "recent_turns" and p.inspect.get("turns", 0) <= 0:
        yield True, "inspect: recent_turns needs turns above 0"


def _routes(p: Policy) -> Found:
    names = [r.get("name", "") for r in p.routes]
    for i, r in enumerate(p.routes):
        where = f"routes[{i}]"
        if not names[i]:
            yield False, f"{where}: no name, so its number is logged"
        elif names[i] in names[:i]:
            yield True, f"{where}: {names[i]!r} is there already"
        if r.get("to") != KEEP and p.rank(r.get("to", "")) < 0:
            yield True, f"{where}: to={r.get('to')!r} is no tier"
        yield from _rule(p, r.get("when", {}), f"{where}.when", 1)
        if uses_model(r.get("when", {})):
            yield False, f"{where}: consults a model; cheap routes belong above it"


def _rule(p: Policy, rule: dict, where: str, depth: int) -> Found:
    groups, leaves = [g for g in GROUPS if g in rule], [k for k in LEAVES if k in rule]
    if depth > MAX_DEPTH:
        yield True, f"{where}: nested deeper than {MAX_DEPTH}"
    elif not groups and not leaves:
        yield True, f"{where}: empty condition"
    elif len(groups) > 1:
        yield True, f"{where}: only one of {', '.join(GROUPS)}"
    elif groups and leaves:
        yield True, f"{where}: a group or a condition, not both"
    elif len(leaves) > 1:
        yield True, f"{where}: several conditions; join them by all"
    elif groups == ["not"]:
        yield from _rule(p, rule["not"], f"{where}.not", depth + 1)
    elif groups:
        items = rule[groups[0]]
        if not items:
            yield True, f"{where}.{groups[0]}: empty group"
        if len(items) == 1:
            yield False, f"{where}.{groups[0]}: a group of one"
        for i, r in enumerate(items):
            yield from _rule(p, r, f"{where}.{groups[0]}[{i}]", depth + 1)
    else:
        yield from _leaf(p, leaves[0], rule[leaves[0]], f"{where}.{leaves[0]}")


def _leaf(p: Policy, kind: str, value, where: str) -> Found:
    if kind in ("context_tokens", "message_count"):
        yield from _bounds(value, where)
    elif kind in ("keywords", "keywords_regex", "requested_model"):
        if not value:
            yield True, f"{where}: empty list"
        for pattern in value if kind == "keywords_regex" else []:
            if len(pattern) > MAX_REGEX:
                yield True, f"{where}: pattern longer than {MAX_REGEX}"
                continue
            try:
                re.compile(pattern)
            except re.error as e:
                yield True, f"{where}: invalid pattern {pattern!r}: {e}"
    elif kind in ("domain", "embedding"):
        if p.signal(kind + "s", value) is None:
            yield True, f"{where}: {value!r} is no signal"
    elif kind == "complexity":
        name, _, level = value.rpartition(":") if ":" in value else (value, "", "")
        if p.signal("complexity", name) is None:
            yield True, f"{where}: {name!r} is no signal"
        elif level not in LEVELS:
            yield True, f"{where}: level must be one of {', '.join(LEVELS)}"


def _bounds(b: dict, where: str) -> Found:
    if not b:
        yield True, f"{where}: no bound"
        return
    for k, v in b.items():
        if v < 0:
            yield False, f"{where}: negative {k}, counts never are"
    if "eq" in b and len(b) > 1:
        yield True, f"{where}: eq stands alone"
        return
    if {"gt", "gte"} <= set(b):
        yield True, f"{where}: one lower bound only"
    if {"lt", "lte"} <= set(b):
        yield True, f"{where}: one upper bound only"
    low = b.get("gte", b["gt"] + 1 if "gt" in b else None)
    high = b.get("lte", b["lt"] - 1 if "lt" in b else None)
    if low is not None and high is not None and low > high:
        yield True, f"{where}: nothing lies between {low} and {high}"


def _signals(p: Policy) -> Found:
    for kind in ("domains", "embeddings", "complexity"):
        found = (p.signals or {}).get(kind, [])
        names = [s.get("name", "") for s in found]
        for i, s in enumerate(found):
            where = f"signals.{kind}[{i}]"
            if not names[i]:
                yield True, f"{where}: no name"
            elif names[i] in names[:i]:
                yield True, f"{where}: {names[i]!r} is there already"
            if kind == "domains":
                if not s.get("categories"):
                    yield True, f"{where}: no categories"
                if not 0 <= s.get("min_mass", 0) <= 1:
                    yield True, f"{where}: min_mass must lie in 0 .. 1"
                for c in s.get("categories", []):
                    if c not in CATEGORIES:
                        yield False, f"{where}: {c!r} is never emitted"
            else:
                for bank in ("candidates",) if kind == "embeddings" else ("hard", "easy"):
                    yield from _candidates(s.get(bank, []), f"{where}.{bank}")
                level = s.get("threshold", 0)
                if kind == "embeddings" and not 0 <= level <= 1:
                    yield False, f"{where}: threshold outside 0 .. 1"
                if kind == "complexity" and level < 0:
                    yield True, f"{where}: threshold must not be negative"
                if kind == "complexity" and ":" in names[i]:
                    yield True, f"{where}: no ':' in a complexity name"


def _candidates(found: list[str], where: str) -> Found:
    full = [c for c in found if c]
    if not found:
        yield True, f"{where}: empty"
    elif not full:
        yield True, f"{where}: only empty texts"
    if len(found) > MAX_CANDIDATES:
        yield True, f"{where}: {len(found)}, at most {MAX_CANDIDATES}"
    elif len(found) > MANY_CANDIDATES:
        yield False, f"{where}: {len(found)} are many"
    for c in sorted({c for c in full if full.count(c) > 1}):
        yield False, f"{where}: {c!r} is there twice"


def _session(p: Policy) -> Found:
    jump = (p.session or {}).get("min_band_jump", 0)
    if jump < 0:
        yield True, "session.min_band_jump: must not be negative"
    if (p.session or {}).get("sticky") and jump < 2:
        yield False, "session: sticky holds nothing below min_band_jump 2"
