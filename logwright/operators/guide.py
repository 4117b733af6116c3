"""A guide to a log: what a resolver makes of its profile, section by section,
checked against the profile. The resolver is any function from a section's
name and facts to a dictionary; no language model is called here."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from logwright.log import Log
from logwright.operators import profile

#: Where a column's values come from.
VALUE_SOURCES = ("peer_objects", "events", "object_id", "domain_knowledge", "derived_from_other_attributes", "unknown")


def all_types(found: dict, guide: dict | None, kind: str = "object") -> list[str]:
    """Types that the profile or the guide knows, in order."""
    return sorted(set(found["types"][kind]) | set((guide or {}).get("types", {})))


def _text(value: object) -> str:
    return value.strip() if isinstance(value, str) else ""


def _section(resolver: Callable, name: str, facts: object, warnings: list[str]) -> dict | None:
    try:
        said = resolver(name, facts)
    except Exception as error:  # noqa: BLE001 - a section that fails leaves the others
        warnings.append(f"{name}: {error}")
        return None
    return said if isinstance(said, dict) else {}


def build_guide(found: dict, resolver: Callable[[str, object], dict], most_failures: int = 2) -> dict:
    """Sections domain, qualifiers, and one for each object type. Names that
    the profile has not are dropped with a warning; after ``most_failures``
    sections in a row that fail no others are tried."""
    guide: dict = {"fingerprint": found["fingerprint"], "domain": {}, "qualifiers": {}, "types": {}, "warnings": []}
    columns = {t: [k.split("/")[2] for k in found["columns"] if k.startswith(f"object/{t}/")] for t in found["types"]["object"]}
    qualifiers = sorted({r["qualifier"] for r in found["qualifiers"] if r["qualifier"]})
    failed = 0
    for name, facts in [("domain", found["types"]), ("qualifiers", qualifiers), *((f"type {t}", columns[t]) for t in columns if t)]:
        if failed >= most_failures:
            guide["warnings"].append(f"stopped before {name}")
            break
        said = _section(resolver, name, facts, guide["warnings"])
        failed = failed + 1 if said is None else 0
        if not said:
            continue
        if name == "domain":
            guide["domain"] = {"process": _text(said.get("process"))}
            continue
        parts = said if name == "qualifiers" else said.get("attributes")
        parts = parts if isinstance(parts, dict) else {}
        if unknown := sorted(set(parts) - set(facts)):
            guide["warnings"].append(f"{name}: dropped unknown {unknown}")
        if name == "qualifiers":
            guide["qualifiers"] = {q: _text(parts[q]) for q in facts if q in parts}
            continue
        described = {}
        for column in facts:
            part = parts.get(column)
            part = part if isinstance(part, dict) else {}
            source = part.get("value_source")
            described[column] = {"meaning": _text(part.get("meaning")), "value_source": source if source in VALUE_SOURCES else "unknown", "null_expected": part.get("null_expected") is True, "repair_hint": _text(part.get("repair_hint"))}
        guide["types"][name.removeprefix("type ")] = {"represents": _text(said.get("represents")), "attributes": described}
    return guide


def has_content(guide: dict | None) -> bool:
    return bool(guide and (guide["domain"].get("process") or guide["types"] or guide["qualifiers"]))


def explore(log: Log, folder: str, resolver: Callable[[str, object], dict]) -> dict:
    """Profile and guide of a log, written to a folder. A guide without any
    content never takes the place of one that has some."""
    found, place = profile.profile(log), Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    (place / "profile.json").write_text(json.dumps(found, default=str))
    guide = build_guide(found, resolver)
    if not has_content(guide) and has_content(load(folder)):
        raise RuntimeError("nothing was found out; the guide stays as it was. " + "; ".join(guide["warnings"][-1:]))
    (place / "guide.json").write_text(json.dumps(guide))
    return guide


def load(folder: str, name: str = "guide") -> dict | None:
    path = Path(folder) / f"{name}.json"
    return json.loads(path.read_text()) if path.exists() else None


def fresh_hints(log: Log, folder: str, ocel_type: str, attribute: str | None = None) -> dict:
    """Hints for a violation: none if the profile is of another schema; facts
    alone if only the guide is."""
    found, guide = load(folder, "profile"), load(folder)
    if found is None or profile.hints_are_stale(found, log):
        return {}
    hints = profile.select_hints(found, ocel_type, attribute)
    if guide is not None and guide["fingerprint"] == found["fingerprint"]:
        hints["guide"] = guide["types"].get(ocel_type, {})
    return hints
