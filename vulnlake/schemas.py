"""Schemas of findings, metadata documents and their enriched form; always passed, never inferred."""

from __future__ import annotations

FINDING = "cweId string, ruleId string, vulnerability string, severity string, message string, file string, line int, column int, evidence string"
FINDING_STRUCT = "struct<" + ", ".join(":".join(f.split()) for f in FINDING.split(", ")) + ">"
FIX = "struct<origin:string, replacement:string>"
VULNERABILITY = f"struct<id:string, cwe:string, fixes:array<{FIX}>>"
METADATA = f"schema_version string, id string, language string, path string, split string, source struct<type:string, name:string>, vulnerabilities array<{VULNERABILITY}>"
ENRICHED = f"{METADATA}, static_findings array<{FINDING_STRUCT}>, enriched_at timestamp"
PREDICTION = f"struct<vulnerabilities:array<struct<cwe:string, fixes:array<{FIX}>>>>"
CORPUS = "file string, code string"
FINDING_NAMES = [f.split()[0] for f in FINDING.split(", ")]
