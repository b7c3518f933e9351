"""Content-derived ids: FNV-1a over the code points of key-sorted JSON."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from plumbline.functions.lexing import lex, squeeze, text_of

NAMESPACE, VERSION = "q02a", "v1"
_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1


#: Statements of a corpus share most of their texts; digests and canonical clauses are kept, up to this many of each.
KEPT = 50_000
_digests: dict[str, str] = {}
_clauses: dict[str, str] = {}
_watching: list[dict[str, str]] = []


def _kept(memo: dict, key: str, value: str) -> str:
    if len(memo) >= KEPT:
        memo.clear()
    memo[key] = value
    return value


def fnv(text: str) -> str:
    found = _digests.get(text)
    if found is None:
        h = _OFFSET
        for c in text.encode() if text.isascii() else map(ord, text):
            h = (h ^ c) * _PRIME & _MASK
        found = _kept(_digests, text, f"{h:016x}")
    if _watching:
        _watching[-1][found] = text
    return found


@contextmanager
def watched() -> Iterator[dict[str, str]]:
    """Digests that are made meanwhile, in order, and their texts."""
    _watching.append({})
    try:
        yield _watching[-1]
    finally:
        _watching.pop()


def in_order(keys: Iterable[str]) -> list[str]:
    """Keys in UTF-16 code-unit order."""
    return sorted(keys, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def utf16_order(value):
    """Dicts with keys in UTF-16 code-unit order, all the way down."""
    if isinstance(value, dict):
        return {k: utf16_order(value[k]) for k in in_order(value)}
    return [utf16_order(v) for v in value] if isinstance(value, (list, tuple)) else value


def digest(value) -> str:
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    # by code points and by UTF-16 units the order differs beyond the BMP only
    return fnv(text if text.isascii() else json.dumps(utf16_order(value), ensure_ascii=False, separators=(",", ":")))


def clause_text(value: str | None) -> str:
    """A clause with words in lower case and canonical spacing."""
    value = value or ""
    if value in _clauses:
        return _clauses[value]
    return _kept(_clauses, value, squeeze(text_of([t._replace(value=t.normalized) for t in lex(value)])))


def stable_id(kind: str, signature: dict) -> str:
    return f"{NAMESPACE}-{VERSION}-{kind}-{digest(signature)}"


def attach(records: list[dict]) -> list[dict]:
    """records(id, kind, signature) with stableId; repeated content gets -r02, -r03 ... in order."""
    seen: Counter[str] = Counter()
    out = []
    for r in records:
        base = stable_id(r["kind"], r["signature"])
        seen[base] += 1
        n = seen[base]
        out.append({"id": r["id"], "kind": r["kind"], "stableIdBase": base, "stableOccurrence": n, "stableId": base if n == 1 else f"{base}-r{n:02d}"})
    return out


def resolve(candidate: str | None, identities: list[dict]) -> dict:
    """The entity a legacy or stable id means: resolved, ambiguous or unsupported."""
    wanted = (candidate or "").strip()
    if not wanted:
        return {"status": "unsupported", "reason": "Empty input", "canonicalId": "", "legacyId": ""}
    by_legacy = [i for i in identities if i["id"] == wanted]
    if len({i["stableId"] for i in by_legacy}) > 1:
        return {"status": "ambiguous", "reason": f"Ambiguous legacy ID '{wanted}'", "canonicalId": "", "legacyId": ""}
    found = by_legacy or [i for i in identities if i["stableId"] == wanted]
    if not found:
        return {"status": "unsupported", "reason": "Unknown id", "canonicalId": "", "legacyId": ""}
    return {"status": "resolved", "reason": "", "canonicalId": found[0]["stableId"], "legacyId": found[0]["id"]}
