"""Validation rules: parsed annotations against catalogue tables.

Every rule is decided inside the annotation's own row.  The catalogue facts a
row needs come by look-ups (broadcast while the catalogue is small, spread
sort-merge beyond), the rules are expressions, and one explode turns them into
findings: the annotations are scanned once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from annolake.functions.text import condition_pair, condition_tokens, strip
from annolake.operators.joins import lookup
from annolake.operators.similarity import DEFAULT_THRESHOLD, closest, column_lists

ORDER = ("study_id", "doc_id", "page", "annot_idx", "part_idx", "rule_no", "token_no")


@dataclass(frozen=True)
class Catalog:
    """Metadata tables of one study, or of many told apart by ``study_keys``."""

    datasets: DataFrame
    variables: DataFrame
    supp_values: DataFrame
    relrec_values: DataFrame
    study_keys: tuple[str, ...] = ()

    def dataset_facts(self) -> DataFrame:
        """Per dataset: label and whether it has the columns the special rules read."""
        columns = self.variables.groupBy(*self.study_keys, "domain").agg(
            F.bool_or(F.col("name") == "QNAM").alias("has_qnam"),
            F.bool_or(F.col("name") == "IDVAR").alias("has_idvar"))
        return self.datasets.select(*self.study_keys, "domain", "label").join(
            columns, [*self.study_keys, "domain"], "left").select(
            *self.study_keys, "domain", F.lit(True).alias("exists"),
            F.nullif("label", F.lit("")).alias("label"),
            F.coalesce("has_qnam", F.lit(False)).alias("has_qnam"),
            F.coalesce("has_idvar", F.lit(False)).alias("has_idvar"))

    def known_names(self) -> DataFrame:
        """Names a domain's annotations may use: columns, or QNAM values of a SUPP dataset."""
        is_supp = F.startswith(F.col("domain"), F.lit("SUPP"))
        columns = self.variables.filter(~is_supp).select(
            *self.study_keys, "domain", "name")
        values = self.supp_values.filter(is_supp).select(
            *self.study_keys, "domain", F.col("qnam").alias("name"))
        return columns.unionByName(values).distinct().withColumn("known", F.lit(True))

    def dm_names(self) -> DataFrame:
        return (self.variables.filter("domain = 'DM'").select(*self.study_keys, "name")
                .distinct().withColumn("in_dm", F.lit(True)))

    def link_names(self) -> DataFrame:
        return (self.relrec_values.select(*self.study_keys, F.col("idvar"))
                .distinct().withColumn("linked", F.lit(True)))


@dataclass(frozen=True)
class CheckOptions:
    """Job settings.  ``fuzzy`` off skips the similarity step; ``strict_domains``
    reports an unknown domain on variable rows too, which otherwise yields nothing."""

    ignore_domains: tuple[str, ...] = ()
    ignore_variables: tuple[str, ...] = ("STUDYID", "USUBJID")
    threshold: float = DEFAULT_THRESHOLD
    fuzzy: bool = True
    strict_domains: bool = False
    # domain, variable, condition variable, only value allowed
    condition_rules: tuple[tuple[str, str, str, str], ...] = (
        ("PF", "PFORRES", "PFTESTCD", "CYTABNRM"),)
    salt: int = 1


Rule = Callable[[DataFrame, Catalog], DataFrame]
_CUSTOM: dict[str, Rule] = {}


def register_rule(name: str, rule: Rule) -> None:
    """Add a rule: gated rows and catalogue in, findings (``FINDING`` columns) out."""
    _CUSTOM[name] = rule


def unregister_rule(name: str) -> None:
    _CUSTOM.pop(name, None)


def gate(parsed: DataFrame, catalog: Catalog, options: CheckOptions = CheckOptions()) -> DataFrame:
    """Decide which rules a row meets.

    Adds ``seen_domain`` (before the override), moves variables DM lists to DM,
    and flags ``unmatched``, ``ignored``, ``check_label`` and ``check_variable``.
    """
    studies = [(F.col(k), k) for k in catalog.study_keys]
    rows = parsed.withColumn("seen_domain", F.col("domain"))
    rows = lookup(rows, catalog.dm_names(), [*studies, (F.col("variable_name"), "name")],
                  {"in_dm": "_in_dm"}, options.salt, ["doc_id", "page", "annot_idx"])
    unmatched = F.col("pattern_type").isNull()
    rows = rows.withColumn("domain", F.when(~unmatched & F.col("_in_dm"), F.lit("DM"))
                           .otherwise(F.col("domain"))).drop("_in_dm")
    skip = [d.upper() for d in options.ignore_domains]
    ignored = F.coalesce(F.upper("domain").isin(*skip), F.lit(False)) if skip else F.lit(False)
    active = ~unmatched & ~ignored
    return rows.select("*", unmatched.alias("unmatched"), (~unmatched & ignored).alias("ignored"),
                       (active & F.col("label").isNotNull() & F.col("domain").isNotNull())
                       .alias("check_label"),
                       (active & ~F.col("is_comment")).alias("check_variable"))


def with_facts(gated: DataFrame, catalog: Catalog,
               options: CheckOptions = CheckOptions()) -> DataFrame:
    """Attach what the catalogue knows about the row's domain, variable and condition."""
    studies = [(F.col(k), k) for k in catalog.study_keys]
    spread = ["doc_id", "page", "annot_idx"]
    domain, variable = F.col("domain"), F.col("variable_name")
    checked = F.col("check_label") | F.col("check_variable")
    # a label row finds its dataset in any letter case, all others exactly
    key = F.when(F.col("check_label") & variable.isNull(), F.upper(domain)).when(checked, domain)
    rows = lookup(gated, catalog.dataset_facts(), [*studies, (key, "domain")],
                  {"exists": "_exists", "label": "_label", "has_qnam": "_has_qnam",
                   "has_idvar": "_has_idvar"}, options.salt, spread)
    rows = rows.withColumn("_exists", F.coalesce("_exists", F.lit(False)))
    named = F.when(F.col("check_variable") & F.col("_exists"), variable)
    rows = lookup(rows, catalog.known_names(), [*studies, (domain, "domain"), (named, "name")],
                  {"known": "_known"}, options.salt, spread)
    rows = rows.withColumn("_known", F.coalesce("_known", F.lit(False)))

    ignored = list(options.ignore_variables)
    is_supp = F.startswith(domain, F.lit("SUPP"))
    rows = rows.withColumn("_missing", F.coalesce(
        named.isNotNull() & ~is_supp & ~F.col("_known") & ~variable.isin(*ignored), F.lit(False)))
    rows = rows.withColumn("_supp_missing", F.coalesce(
        named.isNotNull() & is_supp & ~(F.col("_known") & F.col("_has_qnam"))
        & ~F.upper(variable).isin(*ignored), F.lit(False)))
    empty = F.lit(None).cast("struct<name:string,ratio:double,ratio_text:string>")
    if options.fuzzy:
        wanted = F.when(F.col("_missing"), domain)
        rows = lookup(rows, column_lists(catalog.variables, catalog.study_keys),
                      [*studies, (wanted, "domain")], {"columns": "_columns"},
                      options.salt, spread)
        rows = rows.withColumn("_closest", closest(
            F.when(F.col("_missing"), variable), F.col("_columns"), options.threshold)).drop("_columns")
    else:
        rows = rows.withColumn("_closest", empty)

    linked = (F.col("check_variable") & F.col("_exists") & (domain == "RELREC")
              & F.col("condition").isNotNull())
    rows = rows.withColumn("_link_rule", F.coalesce(linked, F.lit(False)))
    tokens = F.when(F.col("_link_rule") & F.col("_has_idvar"), condition_tokens(F.col("condition")))
    rows = rows.select("*", F.posexplode_outer(tokens).alias("token_no", "_token"))
    rows = lookup(rows, catalog.link_names(), [*studies, (F.col("_token"), "idvar")],
                  {"linked": "_linked"}, options.salt, spread)
    return rows.withColumn("token_no", F.coalesce("token_no", F.lit(0)))


def _finding(rule_no: int, when: Column, severity: str, category: str, message: Column,
             suggestion: str | None = None) -> Column:
    return F.when(when, F.struct(
        F.lit(rule_no).alias("rule_no"), F.col("token_no"), F.lit(severity).alias("severity"),
        F.lit(category).alias("category"), message.alias("message"),
        F.lit(suggestion).cast("string").alias("suggested_correction")))


def _quoted(col) -> Column:
    return F.concat(F.lit("'"), col, F.lit("'"))


def rule_findings(options: CheckOptions = CheckOptions()) -> list[Column]:
    """The built-in rules over a row with facts, in the order findings are listed."""
    domain, variable, label = F.col("domain"), F.col("variable_name"), F.col("label")
    first = F.col("token_no") == 0
    labelled = first & F.col("check_label")
    exists, known_label = F.col("_exists"), F.col("_label")
    same = F.lower(strip(label)) == F.lower(strip(known_label))
    strict = F.lit(options.strict_domains) & F.col("check_variable") & variable.isNotNull()
    near = F.col("_closest.name").isNotNull()
    not_found = F.concat(F.lit("Variable "), _quoted(variable), F.lit(" not found in "), domain)
    rules = [
        _finding(1, first & F.col("unmatched"), "INFO", "Pattern Match",
                 F.lit("Annotation did not match any known pattern"),
                 "Update configuration file with appropriate pattern"),
        _finding(2, first & (F.col("check_label") | strict) & domain.isNotNull() & ~exists,
                 "ERROR", "Wrong Domain",
                 F.concat(F.lit("Domain "), _quoted(domain),
                          F.lit(" not found in SDTM datasets."))),
        _finding(3, labelled & exists & known_label.isNotNull() & ~same, "ERROR",
                 "Metadata Mismatch",
                 F.concat(F.lit("Mismatched dataset label for domain "), _quoted(domain),
                          F.lit(". Expected "), _quoted(known_label), F.lit(", but found "),
                          _quoted(label), F.lit(" in annotation."))),
        _finding(4, labelled & exists & known_label.isNull(), "WARNING", "Metadata Mismatch",
                 F.concat(F.lit("Dataset label for domain "), _quoted(domain),
                          F.lit(" not found in the dataset file."))),
        _finding(5, first & F.col("_missing") & near, "WARNING", "Typo in Variable Name",
                 F.concat(not_found, F.lit(", but similar to "), _quoted(F.col("_closest.name")),
                          F.lit(" (similarity: "), F.col("_closest.ratio_text"), F.lit(")"))),
        _finding(6, first & F.col("_missing") & ~near, "ERROR", "Missing Variable", not_found),
        _finding(7, first & F.col("_supp_missing") & ~F.col("_has_qnam"), "ERROR",
                 "Missing Variable",
                 F.concat(F.lit("Domain "), domain, F.lit(
                     " is a SUPP domain but does not contain QNAM variable."))),
        _finding(8, first & F.col("_supp_missing") & F.col("_has_qnam"), "ERROR",
                 "Missing Variable",
                 F.concat(F.lit("Variable "), _quoted(variable), F.lit(" not found in QNAM of "),
                          domain, F.lit("."))),
        _finding(9, first & F.col("_link_rule") & ~F.col("_has_idvar"), "ERROR",
                 "Missing Variable",
                 F.concat(F.lit("Domain "), domain, F.lit(" does not contain IDVAR variable."))),
        _finding(10, F.col("_token").isNotNull() & F.col("_linked").isNull(), "ERROR",
                 "Missing Variable",
                 F.concat(F.lit("Variable "), _quoted(F.col("_token")),
                          F.lit(" from condition not found in IDVAR of "), domain, F.lit("."))),
    ]
    pair = condition_pair(F.col("condition"))
    for rule_domain, rule_variable, left, allowed in options.condition_rules:
        hit = (first & F.col("check_variable") & (domain == rule_domain)
               & (variable == rule_variable) & (pair["left"] == left)
               & (pair["right"] != allowed))
        rules.append(_finding(
            11, hit, "ERROR", "Incorrect Value",
            F.concat(F.lit(f"Conditional check failed for {rule_variable}: "
                           f"{left} is not {allowed}, but "), pair["right"])))
    return rules


FINDING = ("study_id", "doc_id", "page", "annot_idx", "part_idx", "x0", "y0", "text", "domain",
           "variable_name", "value", "condition", "label", "pattern_type", "is_comment",
           "rule_no", "token_no", "severity", "category", "message", "suggested_correction")


def find(parsed: DataFrame, catalog: Catalog, options: CheckOptions = CheckOptions()) -> DataFrame:
    """All findings of accepted rows, registered rules included."""
    gated = gate(parsed, catalog, options)
    rows = with_facts(gated, catalog, options)
    found = F.array_compact(F.array(*rule_findings(options)))
    decided = ("rule_no", "token_no", "severity", "category", "message", "suggested_correction")
    base = [c for c in FINDING if c in rows.columns and c not in decided]
    findings = rows.select(*base, F.explode_outer(found).alias("_f")).filter(
        "_f is not null").select(*base, *(f"_f.{c}" for c in decided))
    for rule in _CUSTOM.values():
        findings = findings.unionByName(rule(gated, catalog), allowMissingColumns=True)
    return findings


# --- single checks ---------------------------------------------------------

def missing_variables(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """Rows that name a column their (existing) dataset lacks."""
    keys = list(catalog.study_keys)
    rows = parsed.filter(F.col("variable_name").isNotNull() & ~F.startswith("domain", F.lit("SUPP")))
    known = catalog.variables.select(*keys, "domain", F.col("name").alias("variable_name"))
    return (rows.join(catalog.datasets.select(*keys, "domain"), [*keys, "domain"], "left_semi")
            .join(known, [*keys, "domain", "variable_name"], "left_anti"))


def unused_datasets(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """Datasets no parsed row names; the domain counts as written, before the DM override."""
    keys = list(catalog.study_keys)
    seen = parsed.select(*keys, F.coalesce(*(F.col(c) for c in ("seen_domain", "domain")
                                             if c in parsed.columns)).alias("domain")).distinct()
    return (catalog.datasets.select(*keys, "domain").distinct()
            .join(seen, [*keys, "domain"], "left_anti"))


def variable_metadata(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Attach the catalogue entry of each row's variable; nulls where there is none."""
    keys = [*catalog.study_keys, "domain"]
    entry = catalog.variables.select(
        *keys, F.col("name").alias("variable_name"), F.col("type").alias("variable_type"),
        F.col("length").alias("variable_length"), F.col("label").alias("variable_label"),
        F.col("format").alias("variable_format"), F.col("informat").alias("variable_informat"))
    return rows.join(entry, [*keys, "variable_name"], "left")
