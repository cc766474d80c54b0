"""Constraint rules in YAML or JSON: read with defaults, checked as a whole, written back, and listed as tables.

A rule file is a list of rules that the driver reads, as it reads a query; it is no data and is never large.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..graph import NODE_COLUMNS
from ..operators.shapes import ALL, SOME, Shape, parse_path

try:
    import yaml
except ModuleNotFoundError:
    yaml = None

# Operations, severities, and kinds of rules.
OPERATIONS = ("CREATE", "READ", "UPDATE", "DELETE", "EXECUTE", "EXPORT")
SEVERITIES = ("allow", "warn", "block", "escalate")
LABELS = ("CodeEntity", "DocEntity", "ConceptEntity", "ModuleEntity", "RepositoryEntity", "ServiceEntity", "ResourceEntity", "DataAsset")


#: The five rules that a graph of code comes with (fixed values: ids, targets, paths, constraints, severities, priorities).
BUILT_IN = json.dumps(
    {
        "version": "2.1",
        "shapes": [
            {"id": "shape:sensitive_data", "name": "sensitive data", "description": "code that works on restricted or confidential data", "target": {"entry_type": "CodeEntity", "operation": "UPDATE"}, "path": "PROCESSES_DATA -> DataAsset", "constraint": {"field": "sensitivity", "operator": "in", "value": ["restricted", "confidential"]}, "severity": "block", "priority": 10, "suggestion": "Ask the data's owner, or work on data that is not sensitive."},
            {"id": "shape:compliance_check", "name": "compliance", "description": "code under rules of critical or high severity", "target": {"entry_type": "CodeEntity", "operation": "UPDATE"}, "path": "SUBJECT_TO -> ComplianceItem", "constraint": {"field": "severity", "operator": "in", "value": ["critical", "high"]}, "severity": "block", "priority": 8, "suggestion": "Have the rule's exception granted first."},
            {"id": "shape:http_entry_point", "name": "entry point", "description": "entry points that others call", "target": {"entry_type": "CodeEntity", "operation": "UPDATE"}, "path": "SELF", "constraint": {"field": "entry_category", "operator": "in", "value": ["http_api", "rpc_service"]}, "severity": "warn", "priority": 5, "suggestion": "Keep the interface as its callers know it."},
            {"id": "shape:refactor_large_code_unit", "name": "large unit", "description": "units of more than a hundred lines", "target": {"entry_type": "CodeEntity", "operation": "UPDATE"}, "path": "SELF", "constraint": {"field": "lines", "operator": ">", "value": 100}, "severity": "warn", "priority": 3, "suggestion": "Split the unit before it is changed."},
            {"id": "shape:upstream_call_chain_risk", "name": "upstream entry point", "description": "code that entry points call over some steps", "target": {"entry_type": "CodeEntity", "operation": "UPDATE"}, "path": "^CALLS{1,5} -> CodeEntity", "max_depth": 5, "constraint": {"field": "entry_category", "operator": "in", "value": ["http_api", "rpc_service"]}, "severity": "warn", "priority": 6, "suggestion": "Test the entry points above."},
        ],
    }
)


def built_in() -> list[Shape]:
    """The built-in rules, read as any text of rules; their graph has data assets with a sensitivity and compliance items with a severity."""
    return parse_shapes(BUILT_IN, (*LABELS, "ComplianceItem"), (*NODE_COLUMNS, "severity"))


def _loaded(text: str) -> dict:
    found = json.loads(text) if yaml is None or text.lstrip()[:1] == "{" else yaml.safe_load(text)
    return found or {}


def _parts(value: object) -> tuple:
    return tuple(value) if isinstance(value, list | tuple) else (value,)


def _column(name: str) -> str:
    if not str(name).isidentifier():
        raise ValueError(f"{name} is no field")
    return name


def shape_from(rule: dict) -> Shape:
    """One rule as a shape, with defaults for what it leaves out; missing fields and bad values raise ValueError."""
    missing = [k for k in ("id", "name", "description") if k not in rule]
    target, constraint = rule.get("target") or {}, rule.get("constraint") or {}
    label = target.get("entry_type") or target.get("resource_type")
    missing += [k for k, has in (("target.operation", "operation" in target), ("target.entry_type", label), ("constraint.field", "field" in constraint)) if not has]
    if missing:
        raise ValueError(f"rule {rule.get('id', '?')} lacks {', '.join(missing)}")
    operation, severity = str(target["operation"]).upper(), rule.get("severity", "warn")
    confidence = float(rule.get("confidence", 1.0))
    if operation not in OPERATIONS or severity not in SEVERITIES or not 0 <= confidence <= 1:
        raise ValueError(f"rule {rule['id']} has a bad operation, severity or confidence")
    depth = int(rule.get("max_depth", 3))
    parse_path(rule.get("path", ""), depth)
    operator, value = constraint.get("operator", "in"), constraint.get("value")
    unless = (constraint["unless_field"], _parts(constraint.get("unless_value"))) if constraint.get("unless_field") else None
    return Shape(
        rule["id"], rule.get("path", ""), constraint["field"], operator, _parts(value) if operator in ("in", "not_in") else value, severity, int(rule.get("priority", 0)), str(rule.get("suggestion", "")),
        label=label, operation=operation, max_depth=depth, enabled=bool(rule.get("enabled", True)), unless=unless, name=rule["name"], description=rule["description"], ontology_ref=target.get("ontology_ref"), confidence=confidence,
        field_filter=" and ".join(f"{_column(k)} = '{str(v).replace("'", "''")}'" for k, v in sorted(target["field_filter"].items())) if target.get("field_filter") else None,
    )


def checked(shape: Shape, labels: tuple[str, ...] = LABELS, fields: tuple[str, ...] = tuple(NODE_COLUMNS)) -> None:
    """Raise ValueError with all that is wrong: unknown labels, fields that the end of the path lacks, unknown operators."""
    _, end = parse_path(shape.path, shape.max_depth)
    wrong = [f"unknown label {x}" for x in (shape.label, end) if x is not None and x not in labels]
    wrong += [] if shape.field in fields else [f"{end or shape.label} has no field {shape.field}"]
    wrong += [] if shape.operator in SOME or shape.operator in ALL else [f"unknown operator {shape.operator}"]
    if wrong:
        raise ValueError("; ".join(wrong))


def parse_shapes(text: str, labels: tuple[str, ...] = LABELS, fields: tuple[str, ...] = tuple(NODE_COLUMNS)) -> list[Shape]:
    """All rules of a text, or one ValueError that names every bad one; ids must differ. A text without rules has none."""
    rules = _loaded(text).get("shapes") or []
    if not isinstance(rules, list):
        raise ValueError("shapes must be a list")
    out: dict[str, Shape] = {}
    errors = []
    for k, rule in enumerate(rules):
        try:
            shape = shape_from(rule)
            checked(shape, labels, fields)
            if shape.id in out:
                raise ValueError("the id is there already")
            out[shape.id] = shape
        except (ValueError, TypeError, AttributeError) as e:
            errors.append(f"[{k}] {e}")
    if errors:
        raise ValueError(f"{len(errors)} bad rules:\n" + "\n".join(errors))
    return list(out.values())


def read_shapes(spark: SparkSession, path: str, **known: tuple[str, ...]) -> list[Shape]:
    """parse_shapes() of a file that Spark can open."""
    return parse_shapes("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()), **known)


def written(shapes: list[Shape]) -> str:
    """The rules as a text that parse_shapes() reads."""

    def rule(s: Shape) -> dict:
        value = list(s.value) if isinstance(s.value, tuple) else s.value
        constraint = {"field": s.field, "operator": s.operator, "value": value} | ({"unless_field": s.unless[0], "unless_value": list(s.unless[1])} if s.unless else {})
        target = {"entry_type": s.label, "operation": s.operation} | ({"ontology_ref": s.ontology_ref} if s.ontology_ref else {})
        return {"id": s.id, "name": s.name or s.id, "description": s.description, "target": target, "path": s.path, "constraint": constraint, "severity": s.severity, "priority": s.priority, "suggestion": s.suggestion, "max_depth": s.max_depth, "enabled": s.enabled, "confidence": s.confidence}

    whole = {"version": "2.0", "shapes": [rule(s) for s in shapes]}
    return json.dumps(whole, ensure_ascii=False, indent=1) if yaml is None else yaml.safe_dump(whole, allow_unicode=True, sort_keys=False)


def catalogue(spark: SparkSession, shapes: list[Shape]) -> DataFrame:
    """(id, name, description, label, operation, severity, priority, explanation) of the enabled rules; explanation is the whole rule in JSON."""
    rows = [(s.id, s.name or s.id, s.description, s.label, s.operation, s.severity, s.priority, json.dumps(asdict(s), ensure_ascii=False, sort_keys=True)) for s in shapes if s.enabled]
    return spark.createDataFrame(rows, "id string, name string, description string, label string, operation string, severity string, priority int, explanation string")
