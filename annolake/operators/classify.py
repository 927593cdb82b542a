"""Annotation texts to parsed rows: first matching pattern, fields, lists, validity.

The whole job is one projection per annotation and one explode; it needs no
shuffle, so it scales with the scan.  The winning pattern's number is computed
once and the field expressions only run the winner's regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from annolake.functions.text import condition_pair, infer_domain, nonblank, strip
from annolake.operators.joins import lookup
from annolake.operators.patterns import (BUILTIN_COMMENTS, BUILTIN_PATTERNS, DEFAULT_PATTERNS, FIELD_MARK,
                                         Pattern, builtin_view, java_regex, needed_literals, pattern_lists)
from annolake.schemas import PARSED_FIELDS

# i and u: letter case is ignored for all letters; U and d: white space and
# line ends as Python sees them.
_FLAGS = "(?iuUd)"


def _start(regex: str, flags: str = _FLAGS) -> str:
    """The regex held to the text's first character, anchored or not."""
    return rf"{flags}\A(?:{java_regex(regex)})"


def first_match(text: Column, patterns, lower: Column | None = None) -> Column:
    """Number (from 1) of the first pattern that matches, else null.

    ``lower``, the text in lower case, spares the regexes of patterns whose fixed parts the
    text lacks.
    """
    rule = F.when(F.lit(False), F.lit(0))
    for i, p in enumerate(patterns, 1):
        hit = text.rlike(_start(p.regex))
        if lower is not None:
            for piece in reversed(needed_literals(p.regex)):
                hit = F.contains(lower, F.lit(piece)) & hit
        rule = rule.when(hit, F.lit(i))
    return rule


def _groups(text: Column, winner: Column, patterns) -> Column:
    """The winner's groups, in order of the fields it fills."""
    rule = F.when(F.lit(False), F.array().cast("array<string>"))
    for i, p in enumerate(patterns, 1):
        if p.fields:
            rule = rule.when(winner == i, F.array(*(
                F.regexp_extract(text, _start(p.regex), g) for g in p.fields.values())))
    return rule


def _field(name: str, winner: Column, patterns) -> Column:
    """A field's value: the place of its group differs from pattern to pattern."""
    places = [list(p.fields).index(name) if name in p.fields else -1 for p in patterns]
    if max(places) < 0:
        return F.lit(None).cast("string")
    place = F.try_element_at(F.array(*(F.lit(n) for n in places)), winner)
    return nonblank(F.when(place >= 0, F.get("_groups", place)))


def _flag(winner: Column, patterns, test) -> Column:
    hits = [i for i, p in enumerate(patterns, 1) if test(p)]
    return F.coalesce(winner.isin(*hits), F.lit(False)) if hits else F.lit(False)


def _name(winner: Column, patterns) -> Column:
    # try_: a null index must give a null name, also under ANSI rules
    return F.try_element_at(F.array(*(F.lit(p.name) for p in patterns)), winner)


def parse(annotations: DataFrame, patterns=None, dialect: str = "config", dm_variables=(),
          text: str = "content", study_keys: tuple[str, ...] = (), salt: int = 1) -> DataFrame:
    """Parse every annotation; one output row per variable it names.

    Adds ``text`` (stripped), ``part_idx`` (order within the annotation),
    ``pattern_type``, ``is_comment``, the parsed fields and ``reject_reason``:
    null on accepted rows, unmatched texts included.  ``accepted`` and
    ``rejected`` split the result.

    ``patterns`` is a list for all, or a catalogue table (``patterns.CATALOG_SCHEMA``
    with the ``study_keys``) where studies have their own; studies without a
    catalogue match nothing.
    ``dm_variables`` is a list of names, or a DataFrame with ``name`` (and the
    ``study_keys``) where studies differ.
    """
    if dialect not in ("config", "builtin"):
        raise ValueError(f"unknown dialect {dialect!r}")
    builtin = dialect == "builtin"
    rows = annotations.withColumn("text", strip(F.col(text)))
    if isinstance(patterns, DataFrame):
        if builtin:
            raise ValueError("the built-in dialect has its own patterns")
        rows = _match_listed(rows, patterns, study_keys, salt)
    else:
        if patterns is None:
            patterns = BUILTIN_PATTERNS if builtin else DEFAULT_PATTERNS
        rows = _match(rows, [builtin_view(p) if builtin else p for p in patterns], builtin)

    parts = _parts(builtin)
    keep = [c for c in rows.columns if c not in ("variable_name", "value", "condition",
                                                 "label", "test_cd_variable", "test_cd_value",
                                                 "variable_name_end", "_list", "_winner")]
    rows = rows.select(*keep, F.posexplode_outer(parts).alias("part_idx", "_part"))
    rows = rows.select(*keep, F.coalesce("part_idx", F.lit(0)).alias("part_idx"),
                       *(F.col(f"_part.{f}").alias(f) for f in PARSED_FIELDS if f != "domain"))
    rows = _mark_dm(rows, dm_variables, study_keys, salt)
    rows = rows.withColumn("domain", F.coalesce(
        "domain", infer_domain(F.col("variable_name"), F.col("_is_dm")))).drop("_is_dm")
    order = [c for c in annotations.columns] + [
        "text", "part_idx", "pattern_type", "is_comment", *PARSED_FIELDS]
    return rows.select(*order, reject_reason(builtin).alias("reject_reason"))


def _match(rows: DataFrame, patterns: list[Pattern], builtin: bool) -> DataFrame:
    """``rows`` with the winner's name, flag and fields."""
    winner, stripped = F.col("_winner"), F.col("text")
    # what comes out of an explode is not computed again by the steps and
    # filters after it, so each text meets the regexes once
    rows = rows.withColumn("_lower", F.lower(stripped))
    rows = rows.select("*", F.explode_outer(F.array(first_match(stripped, patterns, F.col("_lower"))))
                       .alias("_winner")).drop("_lower")
    rows = rows.select("*", F.explode_outer(F.array(_groups(stripped, winner, patterns))).alias("_groups"))
    fields = {f: _field(f, winner, patterns) for f in PARSED_FIELDS}
    rows = rows.select("*", *(e.alias(f) for f, e in fields.items()),
                       _field("variables", winner, patterns).alias("_list")).drop("_groups")
    comment = (lambda p: p.name in BUILTIN_COMMENTS) if builtin else (lambda p: p.is_comment)
    return rows.select("*", _name(winner, patterns).alias("pattern_type"),
                       _flag(winner, patterns, comment).alias("is_comment"))


def _match_listed(rows: DataFrame, catalog: DataFrame, study_keys: tuple[str, ...], salt: int) -> DataFrame:
    """The same with patterns that are data: each row brings its study's list, tries it in
    order up to the first match, and turns that into its fields by one replacement."""
    fields = (*PARSED_FIELDS, "variables")
    lists = pattern_lists(catalog, fields, _FLAGS, study_keys)
    if not study_keys:  # one list for all
        lists = lists.withColumn("_all", F.lit(1))
    on = [(F.col(k), k) for k in study_keys] or [(F.lit(1), "_all")]
    rows = lookup(rows, lists, on, {"patterns": "_patterns"}, salt, ["doc_id", "page", "annot_idx"])
    entry = "struct<ordinal:int,name:string,is_comment:boolean,test:string,whole:string,template:string>"
    text = F.translate("text", FIELD_MARK, " ")
    first = F.aggregate("_patterns", F.lit(None).cast(entry), lambda found, p: F.when(
        found.isNull() & F.rlike(text, p["test"]), p).otherwise(found))
    rows = rows.select("*", F.explode_outer(F.array(first)).alias("_winner")).drop("_patterns")
    rows = rows.withColumn("_groups", F.split(F.regexp_replace(text, F.col("_winner.whole"), F.col("_winner.template")), FIELD_MARK))
    return rows.select(
        "*", *(nonblank(F.get("_groups", F.lit(i))).alias("_list" if f == "variables" else f) for i, f in enumerate(fields)),
        F.col("_winner.name").alias("pattern_type"), F.coalesce("_winner.is_comment", F.lit(False)).alias("is_comment")).drop("_groups")


def _parts(builtin: bool) -> Column:
    """The rows an annotation gives: one per listed variable, two for a record link."""
    plain = {f: F.col(f) for f in PARSED_FIELDS if f != "domain"}
    both = F.col("test_cd_variable").isNotNull() & F.col("test_cd_value").isNotNull()
    plain["condition"] = F.when(both, F.concat("test_cd_variable", F.lit(" = "), "test_cd_value")
                                ).otherwise(F.col("condition"))
    if builtin:
        plain["test_cd_variable"] = plain["test_cd_value"] = F.lit(None).cast("string")

    def part(**changes) -> Column:
        values = {**plain, **changes}
        return F.struct(*(values[f].cast("string").alias(f) for f in plain))

    none = F.lit(None).cast("string")
    bare = dict(label=none, test_cd_variable=none, test_cd_value=none, variable_name_end=none)
    names = F.filter(F.transform(F.split("_list", "[,/]"), strip), lambda v: v != "")
    listed = F.transform(names, lambda v: part(variable_name=v, condition=F.col("condition"), **bare))
    rule = F.when(F.col("_list").isNotNull(), listed)
    if builtin:
        link = F.col("pattern_type") == "DOMAIN_WHEN_CONDITION"
        pair = condition_pair(F.col("condition"))
        left, right = nonblank(pair["left"]), nonblank(pair["right"])
        rule = rule.when(link & pair.isNotNull(), F.array(
            part(variable_name=left, value=right, condition=none),
            part(variable_name=right, value=left, condition=none)))
        rule = rule.when(link, F.array(part(variable_name=F.lit("IDVAR"))))
    return rule.otherwise(F.array(part()))


def _mark_dm(rows: DataFrame, dm_variables, study_keys, salt: int) -> DataFrame:
    variable = F.col("variable_name")
    if isinstance(dm_variables, DataFrame):
        names = dm_variables.select(*study_keys, "name").distinct().withColumn("_hit", F.lit(True))
        rows = lookup(rows, names, [*((F.col(k), k) for k in study_keys), (variable, "name")],
                      {"_hit": "_is_dm"}, salt, ["doc_id", "page", "annot_idx"])
        return rows.withColumn("_is_dm", F.coalesce("_is_dm", F.lit(False)))
    names = list(dm_variables)
    return rows.withColumn("_is_dm", F.coalesce(variable.isin(*names), F.lit(False))
                           if names else F.lit(False))


def reject_reason(builtin: bool = False) -> Column:
    """Why a matched row is dropped; null when it stands."""
    domain, variable, label = F.col("domain"), F.col("variable_name"), F.col("label")
    labelled = label.isNotNull() & domain.isNotNull() & variable.isNull()
    keep = F.col("pattern_type").isNull() | F.col("is_comment") | labelled
    return (F.when(keep, F.lit(None))
            .when(domain.isNull(), F.lit("no domain"))
            .when(variable.isNull() & label.isNull(), F.lit("no variable"))
            .when(~domain.rlike("^([A-Z]{2,6}|SUPP[A-Z]{2,})$"), F.lit("invalid domain name"))
            .when(~variable.rlike("^[A-Z0-9_]+$"), F.lit("invalid variable name")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull())


# --- pattern trials over a corpus ------------------------------------------

def pattern_hits(annotations: DataFrame, patterns=DEFAULT_PATTERNS, text: str = "content",
                 ignore_case: bool = False) -> DataFrame:
    """Every pattern each text matches: one row per hit, with the winner flagged.

    Trials are case-sensitive by default, unlike parsing.  The catalogue is
    tested inside the row, so a text without a hit produces nothing.
    """
    flags = _FLAGS if ignore_case else "(?Ud)"
    tests = [F.when(F.col(text).rlike(_start(p.regex, flags)), F.struct(
                 F.lit(i).alias("ordinal"), F.lit(p.name).alias("pattern_type")))
             for i, p in enumerate(patterns, 1)]
    hits = F.array_compact(F.array(*tests))
    rows = annotations.withColumn("hits", hits).filter(F.size("hits") > 0)
    return rows.select(*annotations.columns, F.size("hits").alias("n_hits"),
                       F.posexplode("hits").alias("hit_no", "_hit")).select(
        *annotations.columns, "n_hits", (F.col("hit_no") == 0).alias("wins"),
        "_hit.ordinal", "_hit.pattern_type")


def pattern_hit_counts(annotations: DataFrame, patterns=DEFAULT_PATTERNS, text: str = "content",
                       ignore_case: bool = False) -> DataFrame:
    """Per pattern: texts it matches, texts it wins, texts it shares with others."""
    hits = pattern_hits(annotations.select(text), patterns, text, ignore_case)
    return hits.groupBy("ordinal", "pattern_type").agg(
        F.count("*").alias("matched"), F.count_if("wins").alias("won"),
        F.count_if(F.col("n_hits") > 1).alias("shared"))


def try_pattern(texts: DataFrame, pattern: Pattern, text: str = "content") -> DataFrame:
    """One pattern against every text: did it match, and which groups (case-sensitive)."""
    regex = _start(pattern.regex, "(?Ud)")
    matched = F.coalesce(F.col(text).rlike(regex), F.lit(False))
    entries = []
    for name, group in pattern.groups.items():
        value = (F.regexp_extract(F.col(text), regex, group)
                 if 0 <= group <= re.compile(pattern.regex).groups else F.lit(None).cast("string"))
        entries += [F.lit(name), value]
    groups = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return texts.select("*", matched.alias("matched"), F.when(matched, groups).alias("groups"))


def expand_range(first: Column, last: Column) -> Column:
    """``VAR1``-``VAR4`` as an array of names; the two ends alone if stems differ."""
    pattern = r"^(.*?)(\d+)$"
    stem, start = F.regexp_extract(first, pattern, 1), F.regexp_extract(first, pattern, 2)
    stop = F.regexp_extract(last, pattern, 2)
    same = (stem == F.regexp_extract(last, pattern, 1)) & (start != "") & (stop != "")
    low, high = start.try_cast("int"), stop.try_cast("int")
    return F.when(same & (low <= high), F.transform(
        F.sequence(low, high), lambda n: F.concat(stem, n.cast("string")))
    ).otherwise(F.array_compact(F.array(first, last)))
