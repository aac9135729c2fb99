"""Readings of a region by several engines, held against each other.

The reading of the most trusted role for the region's kind is proposed. It is trusted only if an
independent one says the same; no majority decides, and every disagreement is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of engine names, the first that is found gives the role.
ROLES = [("vlm", ["qwen", "vlm"]), ("math_recognition", ["formula", "math"]), ("table_recognition", ["table"]), ("ocr", ["ocr", "paddle"]), ("pptx", ["pptx"]), ("native_pdf", ["native", "pymupdf"])]
#: Roles in the order of trust, by kinds.
TRUST = {
    "picture": ["vlm", "pptx", "native_pdf", "ocr"],
    "formula": ["math_recognition", "pptx", "native_pdf", "ocr", "vlm"],
    "table": ["table_recognition", "pptx", "native_pdf", "ocr", "vlm"],
    "text": ["pptx", "native_pdf", "ocr", "vlm"],
}
PICTURES = ["diagram", "chart", "image"]
#: Kinds that a person looks at in any case.
HIGH_RISK = ["formula", "table", "diagram", "chart", "code"]
DONE, OPEN = ["ok", "success", "completed"], ["pending", "not_run", "queued"]
NUMBERS, SIGNS = r"\d+(?:[.,]\d+)*", r"[-+=<>×÷±≤≥]"


def role_of(engine: Column) -> Column:
    out = None
    for role, parts in ROLES:
        has = F.regexp_like(F.lower(engine), F.lit("|".join(parts)))
        out = F.when(has, role) if out is None else out.when(has, role)
    return out.otherwise(F.lower(engine))


def family_of(family: Column, role: Column) -> Column:
    """Readings of one family count once: what they share may be one fault."""
    named = F.lower(F.coalesce(family, role))
    return F.when(F.contains(named, F.lit("paddle")), "paddle").when(F.contains(named, F.lit("native")) | (named == "pymupdf"), "native_pdf").otherwise(named)


def trust(kind: Column, role: Column) -> Column:
    """The place of a role in the order for the kind; roles that are not in it come after all of it."""
    place = lambda names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), role), F.lit(0)), F.lit(len(names) + 1))
    return F.when(kind.isin(PICTURES), place(TRUST["picture"])).when(kind == "formula", place(TRUST["formula"])).when(kind == "table", place(TRUST["table"])).otherwise(place(TRUST["text"]))


def settled(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def cross_validated(readings: DataFrame, record: str = "record") -> DataFrame:
    """record, engine, family, proposed, bucket, usable, rejected, agreeing, conflicts, reasons.

    ``readings``: record, kind, index (unique in its record), engine, family (null: by its role), text,
    status, same_source, bound (whether evidence ties it to the region), faults (array of names).
    A reading is usable if it is done, not blank, without faults and of the record's source; of the usable ones
    that of the most trusted role is proposed, the smaller index first. In texts and code the others,
    descriptions by a vision model aside, are compared with it: they agree if they are equal but for
    white space, one is optical and the other from the file, their families differ and both are bound;
    they conflict if they are not equal, and then numbers and signs are compared too.

    bucket: critical with a reading of another source or with nothing usable and nothing pending; trusted
    if one agrees, none conflicts or was rejected, none is pending and the kind is of low risk; else
    uncertain. Nulls in same_source and bound are false. A record without readings has no row.
    """
    role = role_of(F.col("engine"))
    rows = readings.withColumns({"_role": role, "_family": family_of(F.col("family"), role), "_plain": settled(F.col("text")), "_faults": F.coalesce("faults", F.expr("cast(array() as array<string>)"))})
    same, bound = F.coalesce("same_source", F.lit(False)), F.coalesce("bound", F.lit(False))
    usable = F.coalesce(F.col("status").isin(DONE), F.lit(False)) & (F.col("_plain") != "") & (F.size("_faults") == 0) & same
    rows = rows.withColumns({"_usable": usable, "_same": same, "_bound": bound, "_trust": trust(F.col("kind"), F.col("_role"))})
    best = Window.partitionBy(record).orderBy(F.desc("_usable"), "_trust", "index")
    top = F.first(F.struct(F.col("_usable").alias("ok"), "index", "engine", F.col("_family").alias("family"), F.col("_role").alias("role"), F.col("_plain").alias("plain"), F.btrim("text").alias("text"), F.col("_bound").alias("bound"))).over(best)
    rows = rows.withColumn("_top", top)
    compared = F.col("_usable") & F.col("_top.ok") & (F.col("index") != F.col("_top.index")) & (F.col("_role") != "vlm") & F.col("kind").isin("text", "code")
    equal = F.col("_plain") == F.col("_top.plain")
    roles = F.array("_role", "_top.role")
    optical = F.array_contains(roles, "ocr") & (F.array_contains(roles, "native_pdf") | F.array_contains(roles, "pptx"))
    agrees = compared & equal & optical & (F.col("_family") != F.col("_top.family")) & F.col("_bound") & F.col("_top.bound")
    unlike = lambda pattern: F.regexp_extract_all("_plain", F.lit(pattern), F.lit(0)) != F.regexp_extract_all("_top.plain", F.lit(pattern), F.lit(0))
    count = lambda c: F.count_if(c)
    told = rows.groupBy(record).agg(
        F.first("kind").alias("kind"),
        F.first("_top").alias("top"),
        count(F.col("_usable")).alias("usable"),
        count(~F.col("_usable")).alias("rejected"),
        count(agrees).alias("agreeing"),
        count(compared & ~equal).alias("conflicts"),
        count(compared & ~equal & (unlike(NUMBERS) | unlike(SIGNS))).alias("_numeric"),
        F.bool_or(~F.col("_same")).alias("_foreign"),
        F.bool_or(F.coalesce(F.col("status").isin(OPEN), F.lit(False))).alias("_pending"),
        F.flatten(F.collect_set("_faults")).alias("_faults"),
    )
    some, high = F.col("usable") > 0, F.coalesce(F.col("kind").isin(HIGH_RISK), F.lit(False))
    bucket = F.when(F.col("_foreign") | (~some & ~F.col("_pending")), "critical").when(some & (F.col("agreeing") > 0) & (F.col("conflicts") == 0) & (F.col("rejected") == 0) & ~high, "trusted").otherwise("uncertain")
    why = [
        (F.col("_foreign"), "candidate_source_identity_mismatch"),
        (F.col("conflicts") > 0, "independent_extractors_disagree"),
        (F.col("_numeric") > 0, "numeric_or_sign_disagreement"),
        (some & high, "high_risk_requires_human_review"),
        (some & (F.col("top.role") == "vlm"), "vlm_description_requires_source_review"),
        (some & (F.col("agreeing") == 0) & F.col("kind").isin("text", "code"), "no_independent_exact_transcript_confirmation"),
        (some & ~F.col("top.bound"), "selected_candidate_region_evidence_unbound"),
        (~some & F.col("_pending"), "extraction_pending"),
        (~some & ~F.col("_pending"), "no_usable_extraction"),
        (some & F.col("_pending"), "extractors_pending"),
    ]
    reasons = F.concat(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in why))), F.transform("_faults", lambda x: F.concat(F.lit("candidate_"), x)))
    chosen = lambda name: F.when(some, F.col(f"top.{name}"))
    return told.select(record, chosen("engine").alias("engine"), chosen("family").alias("family"), chosen("text").alias("proposed"), bucket.alias("bucket"), "usable", "rejected", "agreeing", "conflicts", F.array_sort(F.array_distinct(reasons)).alias("reasons"))
