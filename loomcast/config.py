"""Settings: from JSON or YAML files and dotted overrides to dataclasses."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession


def parse(text: str) -> dict[str, Any]:
    """A mapping in JSON, or in YAML where a YAML reader is installed."""
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("the settings are no JSON, and no YAML reader is installed") from None
        found = yaml.safe_load(text)
    if not isinstance(found, Mapping):
        raise ValueError("settings are a mapping")
    return dict(found)


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """The settings of a file wherever Spark reads from; a folder of them is refused."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file of settings, not {len(rows)}")
    return parse(rows[0][0])


def scalar(text: str) -> Any:
    """A value as it is written on a command line: JSON where it is, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return {"True": True, "False": False, "None": None}.get(text, text)


def override(settings: Mapping[str, Any], changes: Iterable[str]) -> dict[str, Any]:
    """Settings with `a.b=value` changes; mappings on the way are made where they are missing."""
    out = json.loads(json.dumps(settings))
    for change in changes:
        name, sign, value = change.partition("=")
        if not sign or not name:
            raise ValueError(f"{change!r} is no name=value")
        *path, last = name.split(".")
        node = out
        for part in path:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"{name}: {part} is a value")
        node[last] = scalar(value)
    return out


def apply(target: Any, values: Mapping[str, Any], strict: bool = True) -> Any:
    """A dataclass with some fields replaced; fields that are dataclasses take mappings. Unknown names
    are an error, or left out."""
    known = {f.name: f for f in dataclasses.fields(target)}
    if strict and (unknown := set(values) - set(known)):
        raise ValueError(f"{type(target).__name__} has no {', '.join(sorted(unknown))}")
    made = {}
    for name in known.keys() & values.keys():
        now = getattr(target, name)
        made[name] = apply(now, values[name], strict) if dataclasses.is_dataclass(now) and isinstance(values[name], Mapping) else values[name]
    return dataclasses.replace(target, **made)


#: What the deployed settings set apart from the defaults: images of a group, the shares of
#: sources, and slower approaches.
DEPLOYED = {
    "curation": {"per_group": 4000, "weight_cap": 8.0, "source_caps": {"noaa_oer": 0.35, "fathomnet": 0.40, "river_herring": 0.15, "puget_sound": 0.10, "brackish": 0.10}},
    "steering": {"ahead": 0.4},
}
