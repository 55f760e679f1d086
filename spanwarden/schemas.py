"""Declared schemas and the severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the most to the least severe; the rank is the place.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

VIOLATION = (
    "rule_id string, rule_name string, severity string, file_path string, line_start int, line_end int, col_start int, col_end int, "
    "message string, snippet string, fix_hint string, references array<string>, confidence double, in_test_file boolean"
)
FILES = "file_path string, content string"
MODELS = "name string, file string, line int, base_classes array<string>, has_delete_method boolean, has_soft_delete boolean"
FIELDS = "model string, name string, field_type string, python_type string, is_nullable boolean, is_encrypted boolean, max_length int, related_model string, on_delete string"
ENDPOINTS = "path string, http_methods array<string>, handler string, file string, line int, models_read array<string>, models_written array<string>, models_deleted array<string>, requires_auth boolean, viewset_class string"
DELETE_PATHS = "source_model string, field_name string, target_model string, on_delete string, is_blocker boolean, file string, line int"
LIBRARIES = "module string, alias string, file string, line int, category string"
PII_FIELDS = "model string, field string, classification string, reason string"
SECTION = "section string, title string, status string, evidence array<string>, blockers array<string>, remediation array<string>, llm_calls_made int"
BASELINE = "version int, created string, total int, violations array<struct<fingerprint:string,rule_id:string,file:string,line:int,message:string>>"
PULL_REQUEST_EVENT = (
    "action string, number int, pull_request struct<number:int,title:string,state:string,draft:boolean,head:struct<sha:string,ref:string>,base:struct<sha:string,ref:string>>, "
    "repository struct<id:long,full_name:string,default_branch:string>, installation struct<id:long>"
)


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, i)
    return out
