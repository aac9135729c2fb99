"""Export of reviewed records: what may be trained on, and why the rest may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.text import nfc

#: Decisions that approve, the one split that is exported, what stands for an address.
APPROVING, EXPORTED, ADDRESS = ["approve", "correct"], "train", "[EMAIL]"
_ADDRESS = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
NOT_APPROVED, CHANGED, DUPLICATE = "not_human_approved_or_stale", "changed_asset", "true_exact_text_and_image_duplicate"


def export_text(text: Column) -> Column:
    """NFC with white space as one space and addresses replaced."""
    return F.regexp_replace(nfc(text), _ADDRESS, ADDRESS.replace("[", r"\[").replace("]", r"\]"))


def region_export(records: DataFrame, reviews: DataFrame, assets: list[tuple[str, str]], strict: bool = False) -> DataFrame:
    """id, reason, canonical_id, text: every record, with its text where it is exported and a reason where not.

    ``records`` are (id, revision, split, pixels, the columns of ``assets``), ``reviews`` are (id, seq, revision,
    decision, verified, text) of which a record's last by ``seq`` counts. It must approve the record as it
    is now: a review of another revision is stale. ``assets`` are pairs of a recorded and a present digest;
    a record without a recorded one needs none, one that differs is held back, with ``strict`` it fails
    the job. The first reason counts: the review, then the split, then assets. Of records with equal text and
    pixels the one of the smallest id stays, and the others name it.

    Null splits are protected, null pixels are equal to each other, a null text is empty. Ids must be distinct,
    and so must ``seq`` in a record; reviews of unknown records count nothing. Reviews and equal texts are
    reduced by digest before a shuffle, so a text that many records have is no hot group.
    """
    last = reviews.groupBy("id").agg(F.max_by(F.struct(F.col("revision").alias("seen"), "decision", "verified", "text"), "seq").alias("r"))
    both = records.join(last, "id", "left")
    approved = F.coalesce(F.col("r.decision").isin(APPROVING) & F.col("r.verified") & F.col("r.seen").eqNullSafe(F.col("revision")), F.lit(False))
    kept = F.coalesce(F.col("split") == EXPORTED, F.lit(False))
    changed = F.lit(False)
    for recorded, present in assets:
        changed = changed | (F.col(recorded).isNotNull() & ~F.col(recorded).eqNullSafe(F.col(present)))
    reason = F.when(~approved, NOT_APPROVED).when(~kept, F.concat(F.lit("protected_"), F.coalesce("split", F.lit("unknown"))))
    reason = reason.when(changed, F.raise_error(F.concat(F.lit("changed asset of record "), F.col("id").cast("string"))).cast("string") if strict else CHANGED)
    judged = both.select("id", "pixels", reason.alias("reason"), F.col("r.text").alias("text"))
    judged = judged.withColumn("text", F.when(F.col("reason").isNull(), export_text(F.coalesce("text", F.lit("")))))
    image = F.coalesce(F.concat(F.lit("1"), F.col("pixels").cast("string")), F.lit("0"))
    keyed = judged.withColumn("_key", F.when(F.col("reason").isNull(), F.sha2(F.concat(F.sha2("text", 256), image), 256)))
    firsts = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min("id").alias("first"))
    named = keyed.join(firsts, "_key", "left")
    repeated = F.col("first").isNotNull() & (F.col("first") != F.col("id"))
    return named.select("id", F.when(repeated, DUPLICATE).otherwise(F.col("reason")).alias("reason"), F.when(repeated, F.col("first")).alias("canonical_id"), F.when(~repeated, F.col("text")).alias("text"))
