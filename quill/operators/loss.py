"""Conversations as token ids with a loss on what the assistant says, by a public tokenizer file.

A message is rendered as a head, its content and the end token. The end token parts what is before it
from what is after it, so that the ids of a conversation are those of its messages one after another:
each turn is encoded by itself, and no task holds a whole conversation.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.operators.ordered import totals_before
from quill.session import stored

END, IGNORED = "<|endoftext|>", -100
ROLES = ("system", "user", "assistant")
ROWS = 256


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def head(role: str, first: bool) -> str:
    return f"### {role}\n" if first else f"\n### {role}\n"


def labelled(tokenizer, rendered: list[str], starts: list[int], wanted: list[bool]) -> Iterator[tuple[list[int], list[int], str | None]]:
    """ids, labels and what is wrong with them, for messages whose contents begin at ``starts``.

    Tokens that lie in the content, and the end token, keep their ids as labels where a loss is wanted.
    A token over the border between head and content is wrong, and so are labels that do not decode to
    the content.
    """
    for whole, start, target, e in zip(rendered, starts, wanted, tokenizer.encode_batch(rendered, add_special_tokens=False), strict=True):
        inside = [a >= start for a, _ in e.offsets]
        wrong = None
        if any(a < start < b for a, b in e.offsets):
            wrong = "token_over_the_border"
        elif target and tokenizer.decode([i for i, own in zip(e.ids, inside, strict=True) if own], skip_special_tokens=False) != whole[start:]:
            wrong = "labels_do_not_decode"
        yield e.ids, [i if own and target else IGNORED for i, own in zip(e.ids, inside, strict=True)], wrong


def encoded_turns(turns: DataFrame, path: str, every: bool = False, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, start, ids, labels, reason: the tokens of each turn, the count of its conversation's tokens before it, and its labels.

    A loss is on the last turn of a conversation, or on ``every`` turn of the assistant; other labels
    are -100. reason: the first that holds of unknown_role, empty (null or blank), reserved_marker (the
    end token's text), repeated_turn (two rows of one number), order (roles do not go system or none, user,
    assistant, user and so on, to an assistant at the end; of the turn where it shows), or what
    ``labelled`` finds. Turns of a null conversation are one conversation.
    """
    own = Window.partitionBy(conv).orderBy(turn)
    rows = turns.select(conv, turn, role, text).withColumns({"_before": F.lag(role).over(own), "_after": F.lead(role).over(own), "_next": F.lead(turn).over(own), "_last": F.lag(turn).over(own)})
    first, last = F.col("_before").isNull(), F.col("_after").isNull()
    follows = F.when(first, F.col(role).isin("system", "user")).when(F.col(role) == "user", F.col("_before").isin("system", "assistant")).when(F.col(role) == "assistant", F.col("_before") == "user").otherwise(False)
    twice = F.coalesce(F.col(turn) == F.col("_next"), F.lit(False)) | F.coalesce(F.col(turn) == F.col("_last"), F.lit(False))
    blank = F.coalesce(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")) == "", F.lit(True))
    reason = F.when(~F.coalesce(F.col(role).isin(*ROLES), F.lit(False)), "unknown_role").when(blank, "empty").when(F.col(text).contains(END), "reserved_marker").when(twice, "repeated_turn").when(~F.coalesce(follows, F.lit(False)) | (last & (F.col(role) != "assistant")), "order")
    rows = rows.select(conv, turn, F.col(role).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"), first.alias("_first"), ((F.col(role) == "assistant") & (last | F.lit(every))).alias("_target"), reason.alias("reason"))
    kept = [rows.schema[conv], rows.schema[turn]]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("reason", T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for whole in it:
            for low in range(0, whole.num_rows, ROWS):
                b = whole.slice(low, ROWS)
                heads = [head(r or "", f) for r, f in zip(b.column("_role").to_pylist(), b.column("_first").to_pylist(), strict=True)]
                # an end token in a text that is refused anyway is left out, so that it parts nothing
                texts = [x.replace(END, "") for x in b.column("_text").to_pylist()]
                made = list(labelled(tokenizer, [h + x + END for h, x in zip(heads, texts, strict=True)], list(map(len, heads)), [bool(x) for x in b.column("_target").to_pylist()]))
                reasons = [r or wrong for r, (_, _, wrong) in zip(b.column("reason").to_pylist(), made, strict=True)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(conv), b.column(turn), pa.array([m[0] for m in made], ints), pa.array([m[1] for m in made], ints), pa.array(reasons, pa.string())], names=schema.names)

    done = stored(rows.mapInArrow(batches, schema), "encoded-turns")
    placed = totals_before(done.select(conv, turn, F.size("ids").cast("long").alias("_n")), [turn], {"start": F.col("_n")}, [conv]).drop("_n")
    same = F.col(f"a.{conv}").eqNullSafe(F.col(f"b.{conv}")) & F.col(f"a.{turn}").eqNullSafe(F.col(f"b.{turn}"))
    # of repeated turns each has a place; they are refused, so that any of them will do
    return done.alias("a").join(placed.groupBy(conv, turn).agg(F.min("start").alias("start")).alias("b"), same).select("a.*", "b.start")


def mask_stats(encoded: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, tokens, supervised, masked, spans, suffix, valid: the loss mask of each conversation.

    spans: stretches of labelled tokens; suffix: whether the last token is labelled; valid: no turn has
    a reason, labels are as many as ids and equal them or are -100, something is labelled, and the end is.
    """
    on = F.transform("labels", lambda x: x != IGNORED)
    n = F.size(F.filter(on, lambda x: x)).cast("long")
    fits = (F.size("ids") == F.size("labels")) & F.forall(F.zip_with("ids", "labels", lambda i, x: (i == x) | (x == IGNORED)), lambda x: x)
    begins = F.size(F.filter(F.zip_with(on, F.concat(F.array(F.lit(False)), F.slice(on, F.lit(1), F.size(on) - 1)), lambda x, y: x & ~y), lambda x: x)).cast("long")
    rows = encoded.select(conv, "start", F.size("ids").cast("long").alias("n"), n.alias("on"), begins.alias("spans"), fits.alias("fits"), F.col("reason").isNull().alias("ok"), F.coalesce(F.element_at("labels", -1) != IGNORED, F.lit(False)).alias("end"))
    stats = rows.groupBy(conv).agg(F.sum("n").alias("tokens"), F.sum("on").alias("supervised"), (F.sum("n") - F.sum("on")).alias("masked"), F.sum("spans").alias("spans"), F.max_by("end", "start").alias("suffix"), F.bool_and(F.col("ok") & F.col("fits")).alias("_fits"))
    return stats.withColumn("valid", F.col("_fits") & F.col("suffix") & (F.col("supervised") > 0)).drop("_fits")


def padded(encoded: DataFrame, batch: str, pad: int, multiple: int = 8, conv: str = "conv_id") -> DataFrame:
    """batch, conv, width, tokens, ids, mask, labels: conversations as long as the longest of their batch, up to a multiple.

    Padding has the id ``pad``, no attention and no loss by its position, so that an end token may pad.
    """
    part = F.array_sort(F.collect_list(F.struct("start", "ids", "labels")))
    rows = encoded.groupBy(batch, conv).agg(part.alias("_parts"))
    whole = lambda c: F.flatten(F.transform("_parts", lambda p: p[c]))
    rows = rows.select(batch, conv, whole("ids").alias("_ids"), whole("labels").alias("_labels")).withColumn("tokens", F.size("_ids").cast("long"))
    widths = rows.groupBy(batch).agg((F.ceil(F.max("tokens") / multiple) * multiple).cast("long").alias("width"))
    rows = rows.join(widths, batch)
    more = (F.col("width") - F.col("tokens")).cast("int")
    fill = lambda column, x: F.concat(column, F.array_repeat(F.lit(x), more))
    return rows.select(batch, conv, "width", "tokens", fill("_ids", pad).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.col("tokens").cast("int")), F.array_repeat(F.lit(0), more)).alias("mask"), fill("_labels", IGNORED).alias("labels"))
