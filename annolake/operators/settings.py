"""Settings: loading with defaults, rule checks, differences between versions.

Settings live as rows ``config_id, key, kind, value`` (kind: bool, int, float,
str, list; value: JSON text), so the checks run over any number of
configurations at once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from annolake.session import small_table

# Shipped settings.
DEFAULTS = {
    "paths": {
        "annotated_crf_file": "",
        "sdtm_directory": "sdtm_data/",
        "output_directory": "output/",
        "default_output_file": "validation_report.xlsx",
    },
    "annotation_patterns.settings": {
        "fuzzy_matching": True,
        "fuzzy_threshold": 0.85,
    },
    "validation": {
        "ignore_domains": [],
        "ignore_variables": ["STUDYID", "USUBJID"],
        "form_bookmark_label": "Form_bookmarks",
        "sdtm_bookmark_label": "SDTM",
        "auto_resize_textboxes": True,
        "resize_max_width_expansion": 200.0,
        "resize_max_height_expansion": 300.0,
        "resize_skip_pages": "",
        "align_annotations": True,
        "align_horizontal": True,
        "align_vertical": True,
        "horizontal_tolerance": 1.0,
        "vertical_tolerance": 10.0,
        "align_skip_pages": "",
        "apply_xfdf_colors": True,
        "standard_red_color": [255, 0, 0],
        "standard_blue_color": [0, 0, 255],
        "standard_green_color": [0, 124, 0],
        "background_color": [0, 255, 255],
        "textbox_border_color": [0, 0, 0],
        "normalize_quotes": True,
    },
}
OLD_THRESHOLD, NEW_THRESHOLD = 0.8, 0.85

SETTINGS_SCHEMA = "config_id string, key string, kind string, value string"
_KINDS = {bool: "bool", int: "int", float: "float", str: "str", list: "list", tuple: "list"}


def load_settings(text: str | None) -> dict[str, dict]:
    """Settings sections from YAML; missing entries take defaults, an old threshold moves up."""
    given = (yaml.safe_load(text) if text else None) or {}
    patterns = given.get("annotation_patterns") or {}
    sections = {"paths": given.get("paths"), "validation": given.get("validation"),
                "annotation_patterns.settings": patterns.get("settings")}
    out = {}
    for name, defaults in DEFAULTS.items():
        # the file locations are taken as a whole, the other sections are filled up
        found = sections[name]
        out[name] = dict(found) if name == "paths" and found else {**defaults, **(found or {})}
    if out["annotation_patterns.settings"]["fuzzy_threshold"] == OLD_THRESHOLD:
        out["annotation_patterns.settings"]["fuzzy_threshold"] = NEW_THRESHOLD
    return out


def settings_rows(spark: SparkSession, configs: dict[str, dict[str, dict]]) -> DataFrame:
    rows = [(name, f"{section}.{key}", _KINDS.get(type(value), "none"), json.dumps(value))
            for name, sections in configs.items()
            for section, entries in sections.items() for key, value in entries.items()]
    return small_table(spark, rows, SETTINGS_SCHEMA)


def with_defaults(settings: DataFrame, defaults: dict[str, tuple[str, str]] | None = None
                  ) -> DataFrame:
    """Fill every configuration's missing keys; ``defaults`` maps key to (kind, JSON value)."""
    if defaults is None:
        defaults = {f"{s}.{k}": (_KINDS[type(v)], json.dumps(v))
                    for s, entries in DEFAULTS.items() if s != "paths" for k, v in entries.items()}
    wanted = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(kind).alias("_kind"),
                                F.lit(value).alias("_value"))
                       for k, (kind, value) in defaults.items()))
    grid = settings.select("config_id").distinct().select(
        "config_id", F.explode(wanted).alias("_d")).select("config_id", "_d.*")
    filled = settings.join(grid, ["config_id", "key"], "full").select(
        "config_id", "key", F.coalesce("kind", "_kind").alias("kind"),
        F.coalesce("value", "_value").alias("value"))
    old = F.endswith("key", F.lit("fuzzy_threshold")) & (
        F.col("value").try_cast("double") == OLD_THRESHOLD)
    return filled.withColumn("value", F.when(old, F.lit(str(NEW_THRESHOLD))).otherwise(F.col("value")))


# --- rules -----------------------------------------------------------------



@dataclass(frozen=True)
class SettingRule:
    """What one setting must be.  ``custom`` maps the value column to an array of
    ``{severity, message}``; nulls in it are dropped."""

    key: str
    title: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    allowed: tuple = ()
    custom: object = field(default=None, hash=False)


def _message(severity: str, when: Column, text: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), text.alias("message")))


_PY_NAMES = {"bool": "bool", "int": "int", "float": "float", "str": "str", "list": "list"}


def _items(value: Column) -> Column:
    """List items as ``{raw, text}``: JSON text, and the string where it is one."""
    raw = F.from_json(value, "array<variant>")
    return F.transform(raw, lambda v: F.struct(
        F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")))


def _is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def _with_errors(messages: Column) -> Column:
    """Warnings of a list only show beside an error of the same list."""
    found = F.array_compact(messages)
    return F.when(F.exists(found, lambda m: m["severity"] == "error"), found).otherwise(
        F.slice(found, 1, 0))


def _json_kind(kind: Column) -> Column:
    return (F.when(kind == "BOOLEAN", F.lit("bool")).when(kind == "VOID", F.lit("NoneType"))
            .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), F.lit("int"))
            .when(F.startswith(kind, F.lit("ARRAY")), F.lit("list"))
            .when(F.startswith(kind, F.lit("OBJECT")), F.lit("dict")).otherwise(F.lit("float")))


def domain_list_check(value: Column) -> Column:
    def check(item: Column) -> Column:
        text, is_text = item["text"], item["kind"] == "STRING"
        filled = is_text & (text != "")
        return F.array(
            _message("error", ~is_text, F.concat(F.lit("Domain must be a string, got "),
                                                 _json_kind(item["kind"]))),
            _message("error", is_text & (text == ""), F.lit("Domain cannot be empty")),
            _message("warning", filled & ~_is_upper(text),
                     F.concat(F.lit("Domain should be uppercase: "), text)),
            _message("warning", filled & (F.length(text) != 2),
                     F.concat(F.lit("Domain should be 2 characters: "), text)))
    return _with_errors(F.flatten(F.transform(_items(value), check)))


def variable_list_check(value: Column) -> Column:
    def check(item: Column) -> Column:
        text, is_text = item["text"], item["kind"] == "STRING"
        filled = is_text & (text != "")
        plain = F.replace(text, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$")
        return F.array(
            _message("error", ~is_text, F.concat(F.lit("Variable must be a string, got "),
                                                 _json_kind(item["kind"]))),
            _message("error", is_text & (text == ""), F.lit("Variable cannot be empty")),
            _message("warning", filled & ~_is_upper(text),
                     F.concat(F.lit("Variable should be uppercase: "), text)),
            _message("error", filled & ~plain,
                     F.concat(F.lit("Variable contains invalid characters: "), text)))
    return _with_errors(F.flatten(F.transform(_items(value), check)))


# The shipped rules.
DEFAULT_RULES = (
    SettingRule("fuzzy_matching", "Fuzzy Matching", "bool"),
    SettingRule("fuzzy_threshold", "Fuzzy Threshold", "float", low=0.0, high=1.0),
    SettingRule("ignore_domains", "Ignore Domains", "list", False, custom=domain_list_check),
    SettingRule("ignore_variables", "Ignore Variables", "list", False, custom=variable_list_check),
    SettingRule("output_format", "Output Format", "str", allowed=("xlsx", "csv", "json")),
    SettingRule("include_timestamp", "Include Timestamp", "bool"),
    SettingRule("max_results", "Max Results", "int", low=1, high=10000),
)


def _rule_messages(rule: SettingRule) -> Column:
    kind, value = F.col("kind"), F.col("value")
    absent = kind.isNull()
    # a boolean also counts as an int, as it does in Python
    typed = kind.isin("int", "bool") if rule.kind == "int" else kind == rule.kind
    found = [
        _message("error", absent & F.lit(rule.required),
                 F.lit(f"Missing required setting: {rule.title}")),
        _message("error", ~absent & ~typed,
                 F.lit(f"{rule.title} must be of type {_PY_NAMES[rule.kind]}"))]
    if rule.kind in ("int", "float"):
        number = F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(
            value.try_cast("double"))
        if rule.low is not None:
            found.append(_message("error", typed & (number < rule.low), F.lit(
                f"{rule.title} must be greater than or equal to {rule.low}")))
        if rule.high is not None:
            found.append(_message("error", typed & (number > rule.high), F.lit(
                f"{rule.title} must be less than or equal to {rule.high}")))
    if rule.allowed:
        texts = [json.dumps(a) for a in rule.allowed]
        found.append(_message("error", typed & ~value.isin(*texts), F.lit(
            f"{rule.title} must be one of: {', '.join(map(str, rule.allowed))}")))
    messages = F.array(*found)
    if rule.custom is not None:
        custom = rule.custom(F.when(typed, value))
        messages = F.concat(messages, F.coalesce(custom, F.slice(messages, 1, 0)))
    return F.array_compact(messages)


def check_settings(settings: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Problems per configuration: ``config_id, rule_no, key, severity, message``.

    Keys are the last part of dotted names.
    """
    named = settings.withColumn("key", F.substring_index("key", ".", -1))
    grid = settings.select("config_id").distinct().select(
        "config_id", F.posexplode(F.array(*(F.lit(r.key) for r in rules))).alias("rule_no", "key"))
    rows = grid.join(named, ["config_id", "key"], "left")
    rule = F.when(F.lit(False), None)
    for i, r in enumerate(rules):
        rule = rule.when(F.col("rule_no") == i, _rule_messages(r))
    return rows.select("config_id", "rule_no", "key", F.posexplode(rule).alias("message_no", "_m")
                       ).select("config_id", "rule_no", "message_no", "key", "_m.severity", "_m.message")


def check_configuration(settings: DataFrame) -> DataFrame:
    """The second check: blank paths, boolean flag, numeric threshold in 0..1."""
    key, kind, value = F.col("key"), F.col("kind"), F.col("value")
    name = F.substring_index(key, ".", -1)
    number = kind.isin("int", "float", "bool")
    amount = F.when(kind == "bool", F.lit(0.5)).otherwise(value.try_cast("double"))
    message = (
        F.when(F.startswith(key, F.lit("paths.")) & value.isin('""', "null"),
               F.concat(name, F.lit(" is required")))
        .when((name == "fuzzy_matching") & (kind != "bool"),
              F.lit("fuzzy_matching must be a boolean"))
        .when((name == "fuzzy_threshold") & ~number, F.lit("fuzzy_threshold must be a number"))
        .when((name == "fuzzy_threshold") & ~amount.between(0, 1),
              F.lit("fuzzy_threshold must be between 0 and 1")))
    return settings.select("config_id", "key", message.alias("message")).filter("message is not null")


def check_patterns(catalog: DataFrame) -> DataFrame:
    """Pattern part of the second check: name, regex and groups must be there."""
    def blank(column: str) -> Column:
        return F.coalesce(column, F.lit("")) == ""

    title = F.when(blank("name"), F.lit("Unnamed")).otherwise(F.col("name"))
    checks = F.array(
        F.when(blank("name"), F.lit("Pattern name is required")),
        F.when(blank("regex"), F.concat(F.lit("Pattern "), title, F.lit(" is missing regex"))),
        F.when(F.coalesce(F.size("groups"), F.lit(0)) <= 0,
               F.concat(F.lit("Pattern "), title, F.lit(" is missing groups"))))
    return catalog.select("ordinal", F.explode(F.array_compact(checks)).alias("message"))


def settings_diff(new: DataFrame, old: DataFrame, on: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Keys of the new settings whose value differs: ``key, old, new``."""
    before = old.select(*on, "key", F.col("value").alias("old"))
    return (new.select(*on, "key", F.col("value").alias("new"))
            .join(before, [*on, "key"], "left")
            .filter(~F.col("old").eqNullSafe(F.col("new"))).select(*on, "key", "old", "new"))
