"""Annotation tables derived from the given tables, for the registered queries.

The given tables hold no annotations; each query derives its input from whole
tables with arithmetic and string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annolake.functions.color import rgb
from annolake.functions.geometry import rect
from annolake.operators.patterns import CATALOG_SCHEMA, DEFAULT_PATTERNS, Pattern
from annolake.operators.rules import Catalog
from annolake.schemas import DATASET_CATALOG, VARIABLE_CATALOG
from annolake.session import small_table

# domain, dataset label
DATASETS = (
    ("DM", "Demographics"), ("AE", "Adverse Events"), ("VS", "Vital Signs"),
    ("LB", "Laboratory Test Results"), ("CM", "Concomitant Medications"),
    ("PF", "Pharmacogenomics Findings"), ("FA", "Findings About"), ("DS", "Disposition"),
    ("XX", None), ("SUPPDM", "Supplemental DM"), ("SUPPAE", "Supplemental AE"),
    ("RELREC", "Related Records"), ("MH", "Medical History"), ("EX", "Exposure"),
    ("EG", "ECG Test Results"), ("TV", "Trial Visits"),
)
COLUMNS = {
    "DM": ("STUDYID", "USUBJID", "SUBJID", "AGE", "SEX", "RACE", "RFICDTC", "BRTHDTC"),
    "AE": ("STUDYID", "USUBJID", "AESEQ", "AETERM", "AEDECOD", "AESTDTC", "AEENDTC", "AESER"),
    "VS": ("STUDYID", "USUBJID", "VSSEQ", "VSTESTCD", "VSORRES", "VSORRESU", "VSSTRESC"),
    "LB": ("STUDYID", "USUBJID", "LBSEQ", "LBTESTCD", "LBORRES", "LBNRIND"),
    "CM": ("STUDYID", "USUBJID", "CMSEQ", "CMTRT", "CMDOSE", "CMSTDTC"),
    "PF": ("STUDYID", "USUBJID", "PFSEQ", "PFTESTCD", "PFORRES"),
    "FA": ("STUDYID", "USUBJID", "FASEQ", "FACAT", "FAOBJ", "FAORRES"),
    "DS": ("STUDYID", "USUBJID", "DSSEQ", "DSCAT", "DSTERM", "DSSTDTC"),
    "XX": ("STUDYID", "XXSEQ"),
    "SUPPDM": ("STUDYID", "USUBJID", "QNAM", "QVAL"),
    "SUPPAE": ("STUDYID", "USUBJID", "QVAL"),
    "RELREC": ("STUDYID", "RDOMAIN", "IDVAR", "IDVARVAL", "RELID"),
    "MH": ("STUDYID", "USUBJID", "MHSEQ", "MHTERM"),
    "EX": ("STUDYID", "USUBJID", "EXSEQ", "EXTRT", "EXDOSE"),
    "EG": ("STUDYID", "USUBJID", "EGSEQ", "EGTESTCD", "EGORRES"),
    "TV": ("STUDYID", "VISITNUM", "VISIT"),
}
QNAMS = ("RACEOTH", "RACE1", "CHILDPOT")
IDVARS = ("FASEQ", "AESEQ")

# Names and domains the texts are filled with: right, misspelt, lower-case, unknown.
NAMES = ("SUBJID", "AGE", "AETERM", "AETRM", "AEDECOD", "VSORRES", "VSORES", "LBORRES", "lbornes",
         "CMTRT", "PFORRES", "FACAT", "DSCAT", "XXABC", "ZZTERM", "RACEOTH", "STUDYID", "MHTERM",
         "EXDOSE", "FAOBJ")
DOMAINS = ("DM", "AE", "VS", "LB", "CM", "ZZ", "XX", "DS", "FA", "ae", "MH")
LABELS = ("Demographics", "adverse events ", "Vital Signs", "Labs", "Concomitant Medications",
          "Disposition", "Findings About", "Medical  History")
# Text templates: {v} a name, {w} another, {d} a domain, {l} a label, {n} a number.
TEMPLATES = (
    "{d} = {l}", "{d}.{v}", "{v}", "{v} = '{l}'", "{v} = {n}", "{v} when {w} = HEIGHT",
    "{v}1 when {w} = HEIGHT", "{v},{w} when VSTESTCD=HEIGHT", "{v}/{w}", "{v} in SUPPDM",
    "{v} in SUPPAE when AGE = {n}", "RELID in RELREC when {v} = AESEQ", "{v}1-{v}4", "[{l}]",
    "NOTE: see page {n}", "NOT SUBMITTED", "{d}-{v}", "{d}|{v}", '{d} {v} = "{n}"',
    "please check {l} again", "PFORRES,{v} when PFTESTCD = {w}", "{v} = '{l}' when {w} = Y",
    "RELREC when {v} = {w}", "{v},{w} = '{l}'", 'DOMAIN={d} VARIABLE={v} VALUE="{n}"',
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it lies, or dealt out to ``spark.annolake.input.pieces`` pieces.

    The setting is for one machine whose tables are one row group each, which Spark
    cannot split; a cluster leaves it unset.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pieces = spark.conf.get("spark.annolake.input.pieces", None)
    return df.repartition(int(pieces)) if pieces else df


def _pick(values, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)),
                        (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def line_annotations(lines: DataFrame) -> DataFrame:
    """One annotation per order line: supplier as document, part as place on a page."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    part = F.col("l_partkey")
    filled = _pick(TEMPLATES, key + part)
    for mark, value in (
            ("{v}", _pick(NAMES, F.col("l_orderkey") + part)), ("{w}", _pick(NAMES, part * 3 + 1)),
            ("{d}", _pick(DOMAINS, F.col("l_orderkey") + F.col("l_linenumber"))),
            ("{l}", _pick(LABELS, part + F.col("l_linenumber"))),
            ("{n}", F.col("l_quantity").cast("int").cast("string"))):
        filled = F.replace(filled, F.lit(mark), value)
    x0 = F.pmod(part * 17, F.lit(500)) + F.col("l_discount") * 100
    y0 = F.pmod(F.col("l_orderkey") * 37, F.lit(700)) + F.col("l_tax") * 100
    wide, high = F.col("l_quantity") * 4 + 10, F.col("l_linenumber") * 4 + 6
    red, green = F.col("l_discount") * 10, F.least(F.col("l_tax") * 12, F.lit(1.0))
    blue = F.col("l_quantity") / 50
    numbers = F.concat_ws(" ", *(c.cast("decimal(6,4)").cast("string")
                                 for c in (red, green, blue)), F.lit("rg"))
    kinds = ("FreeText", "FreeText", "FreeText", "Square", "FreeText", "Highlight", "FreeText")
    return lines.select(
        F.concat(F.lit("ST"), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("study_id"),
        F.concat(F.lit("CRF-"), F.col("l_suppkey").cast("string")).alias("doc_id"),
        (F.pmod(part, F.lit(50)) + 1).cast("int").alias("page"),
        # unique on a page: the order line, then part and quantity, which tell repeats apart
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 50000
         + F.pmod(F.floor(part / 50), F.lit(1000)) * 50
         + F.col("l_quantity").cast("int") - 1).alias("annot_idx"),
        _pick(kinds, F.col("l_linenumber").cast("long") + part).alias("type"),
        F.when(F.col("l_returnflag") == "R", F.lit(" ")).when(
            F.col("l_returnflag") == "A", F.lit("Coder")).alias("author"),
        filled.alias("content"),
        rect(x0, y0, x0 + wide, y0 + high).alias("rect"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("/Helv 10 Tf "), numbers))
        .otherwise(F.lit("/Cour 8 Tf 0 0 0 rg")).alias("da"),
        F.concat(F.lit("0 1 1 rg 0 0 0 rg "), numbers).alias("appearance_text"),
        rgb(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("fill"),
        rgb(red, green, blue).alias("stroke"),
        F.lit(792.0).alias("page_height"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_annotations(table(spark, sf_dir, "lineitem"))


def catalog(spark: SparkSession) -> Catalog:
    """The metadata of one study; a few dozen rows, however many annotations there are."""
    datasets = small_table(spark, [(d, label, None) for d, label in DATASETS], DATASET_CATALOG)
    variables = small_table(spark, 
        [(d, i, n, "character", 8, n.title(), None, None)
         for d, names in COLUMNS.items() for i, n in enumerate(names, 1)], VARIABLE_CATALOG)
    supp = small_table(spark, [("SUPPDM", q) for q in QNAMS], "domain string, qnam string")
    links = small_table(spark, [(v,) for v in IDVARS], "idvar string")
    return Catalog(datasets, variables, supp, links)


#: Datasets that the studies of ``study_folder`` have; study k lacks the k-th column of each.
STUDY_DATASETS = ("DM", "AE", "VS", "SUPPDM", "RELREC")
STUDIES = ("ST0", "ST1", "ST2")


def study_columns(study: str, domain: str) -> list[str]:
    names = list(COLUMNS[domain])
    del names[(STUDIES.index(study) + 2) % len(names)]
    return names


def study_folder(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Datasets of several studies as Parquet, one row a customer; studies differ in
    columns, and in the names that their SUPP and RELREC rows hold."""
    key = F.col("c_custkey")
    for k, study in enumerate(STUDIES):
        for domain in STUDY_DATASETS:
            special = {"QNAM": _pick(QNAMS[:k + 1], key), "IDVAR": _pick(IDVARS[:k % 2 + 1], key)}
            rows = table(spark, sf_dir, "customer").select(*(
                special.get(c, F.concat(F.lit(c), key.cast("string"))).alias(c) for c in study_columns(study, domain)))
            rows.coalesce(1).write.parquet(f"{folder}/{study}/{domain.lower()}.parquet")
    return folder


#: Studies whose catalogues differ: the default one, it reversed and without some entries, none.
STUDY_CATALOGS = {"ST0": "default", "ST1": "default", "ST2": "other", "ST3": "other"}


def other_patterns() -> list[Pattern]:
    return [p for i, p in enumerate(reversed(DEFAULT_PATTERNS)) if i % 5 != 2]


def study_patterns(spark: SparkSession) -> DataFrame:
    """A catalogue table for several studies."""
    lists = {"default": list(DEFAULT_PATTERNS), "other": other_patterns()}
    rows = [(study, i, p.name, p.description, p.regex, dict(p.groups), p.is_comment)
            for study, kind in STUDY_CATALOGS.items() for i, p in enumerate(lists[kind], 1)]
    return small_table(spark, rows, f"study_id string, {CATALOG_SCHEMA}")


def part_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of many studies with mistakes: brand as study, part as entry."""
    n = F.col("p_partkey")
    name = F.when(n % 13 == 0, F.lit(" ")).when(n % 17 != 0, F.concat(F.lit("P"), (n % 40).cast("string")))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("study_id"), n.cast("int").alias("ordinal"), name.alias("name"),
        F.when(n % 7 == 0, F.lit("")).otherwise(F.col("p_name")).alias("description"),
        F.when(n % 5 == 0, F.concat(F.lit("("), F.col("p_type"))).otherwise(F.col("p_type")).alias("regex"),
        F.create_map(F.lit("value"), (n % 4 - 1).cast("int")).alias("groups"), F.lit(False).alias("is_comment"))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per event: user as document, event number as page, type as form."""
    form = F.concat(F.lit("Form: "), F.initcap("event_type"))
    text = (F.when(F.col("value") < 5, F.concat(F.lit("x\n"), F.col("event_type"), F.lit(" log\nbody")))
            .when(F.col("value") < 8, F.lit("a\nb"))
            .otherwise(F.concat(F.lit("Study\n"), form, F.lit("\nbody"))))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("doc_id"),
        (F.col("event_id") + 1).cast("int").alias("page"), text.alias("text"))


def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation per event on its own page: headers, capital headers and item texts."""
    number = F.col("event_id") + F.col("user_id")
    domain = _pick(("DM", "AE", "VS", "LB", "CM"), number)
    content = (F.when(F.col("value") < 20, F.concat(domain, F.lit(" = "), F.initcap("event_type")))
               .when(F.col("value") < 40, F.concat(domain, F.lit("="), F.upper("event_type"), F.lit(" DATA")))
               .otherwise(F.concat(domain, F.lit("TERM of the "), F.col("event_type"),
                                   F.lit(" case numbered "), F.floor("value").cast("string"))))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("doc_id"),
        (F.col("event_id") + 1).cast("int").alias("page"),
        F.col("event_id").alias("annot_idx"), content.alias("content"))


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes for layout: user as document, twenty pages, coordinates from number and value."""
    number = F.col("event_id")
    x0 = F.bround("value", 0)
    y0 = F.pmod(number * 37, F.lit(700)) + F.pmod(number, F.lit(8)) / 4
    return table(spark, sf_dir, "events").select(
        F.lit("ST1").alias("study_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("doc_id"),
        (F.pmod(number, F.lit(20)) + 1).cast("int").alias("page"), number.alias("annot_idx"),
        F.when(F.col("event_type") == "error", F.lit("Square")).otherwise(F.lit("FreeText")).alias("type"),
        F.concat(F.lit("Annotation of the "), F.col("event_type"), F.lit(" event")).alias("content"),
        rect(x0, y0, x0 + 60, y0 + 12).alias("rect"), F.lit("/Helv 10 Tf 0 0 1 rg").alias("da"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(table(spark, sf_dir, "events"))


def audit_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "event_type",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("did "), F.col("event_type")).alias("action"),
        F.col("props").alias("details"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("status"),
        F.lit(None).cast("string").alias("ip_address"))
