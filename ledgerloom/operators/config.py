"""Classifiers, rule sets and routes from files, so that document types are added without code."""

from __future__ import annotations

import json
from pathlib import Path

from .classify import WEIGHTS

DEFAULTS = dict(weights=dict(strong=5, medium=2, weak=1), global_penalties=dict(negative=-2, strong_negative=-5), threshold=6, margin=3)


def _read(path: Path) -> dict:
    """A JSON or YAML object; {} for a damaged file, for anything but an object, and for YAML where no YAML reader is installed."""
    try:
        if path.suffix.lower() in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError:
                found = json.loads(path.read_text(encoding="utf-8"))  # JSON is YAML, too
            else:
                found = yaml.safe_load(path.read_text(encoding="utf-8"))
        else:
            found = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def classifiers(folder: str) -> tuple[list[tuple[str, int, str, str]], dict, dict[str, list[str]]]:
    """(rules, settings, confusions) from a folder of JSON files, one for each document type; ``common.json`` holds weights, threshold and margin.

    Files with ``"enabled": false`` are passed over. Keywords are lists by bucket; a bare list, or lists under other names, are weak ones.
    """
    settings, rules, confusions = {**DEFAULTS, **_read(Path(folder) / "common.json")}, [], {}
    for path in sorted(Path(folder).glob("*.json")):
        found = _read(path)
        name = str(found.get("doc_type") or path.stem).upper()
        if not found or name == "COMMON" or found.get("enabled") is False:
            continue
        words = found.get("keywords") or {}
        buckets = words if isinstance(words, dict) else {"weak": words}
        for bucket, some in buckets.items():
            for word in some if isinstance(some, list) else ():
                rules.append((name, int(found.get("priority") or 0), bucket if bucket in WEIGHTS else "weak", str(word)))
        if targets := [str(t).upper() for t in found.get("anti_confusion_targets") or () if t]:
            confusions[name] = targets
    return rules, settings, confusions


def rule_sets(folder: str) -> dict[str, list[tuple]]:
    """Rules for :func:`extract.matches` by rule set: every file holds ``{"rules": [{field, id, pattern, group, many, flags}]}`` and is named as its set."""
    out: dict[str, list[tuple]] = {}
    for path in sorted(p for kind in ("*.json", "*.yaml", "*.yml") for p in Path(folder).glob(kind)):
        for nth, rule in enumerate(_read(path).get("rules") or (), 1):
            if isinstance(rule, dict) and rule.get("field") and rule.get("pattern"):
                flags = "".join(f[0].lower() for f in rule.get("flags") or ())
                out.setdefault(path.stem, []).append((rule["field"], str(rule.get("id") or f"{path.stem}-{nth}"), rule["pattern"], int(rule.get("group") or 0), bool(rule.get("many", True)), flags))
    return out


def routes(path: str) -> tuple[dict[str, list[str]], bool]:
    """(rule sets by document type, whether the common one is for all) from ``{"routes": {type: [names]}, "include_common": true}``."""
    found = _read(Path(path))
    return {str(k).upper(): [str(x) for x in v] for k, v in (found.get("routes") or {}).items() if isinstance(v, list)}, bool(found.get("include_common", True))
