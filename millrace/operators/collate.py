"""Training examples from token ids: length filter, prompt mask, right padding; all on arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free

#: The label that a loss passes over.
IGNORED = -100


def example(prompt: Column, answer: Column) -> Column:
    """STRUCT<input_ids, labels>: the answer after the prompt; the prompt's labels are masked."""
    masked = F.transform(prompt, lambda _: F.lit(IGNORED).cast("bigint"))
    ids, said = prompt.cast("array<bigint>"), answer.cast("array<bigint>")
    return F.struct(F.concat(ids, said).alias("input_ids"), F.concat(masked, said).alias("labels"))


def fits(prompt: Column, answer: Column, max_length: int) -> Column:
    """An answer, and prompt and answer within ``max_length`` tokens; too long ones are left out, never cut."""
    return (F.size(answer) > 0) & (F.size(prompt) + F.size(answer) <= max_length)


def padded(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(0), width - F.size(ids)).cast("int")))


def collated(df: DataFrame, example_column: str, position: str, batch_size: int, pad_id: int = 0) -> DataFrame:
    """Rows with batch, input_ids, labels and attention_mask, padded on the right to the longest of ``batch_size`` successive positions."""
    if "batch" in {c.lower() for c in df.columns}:
        raise ValueError("the rows have a column named batch")
    n, w = free(df, "size", "width")
    sized = df.withColumn("batch", F.floor(F.col(position) / batch_size)).withColumn(n, F.size(F.col(example_column)["input_ids"]))
    wide = sized.withColumn(w, F.max(n).over(Window.partitionBy("batch")))
    e = F.col(example_column)
    seen = F.transform(e["input_ids"], lambda _: F.lit(1).cast("bigint"))
    made = {"input_ids": padded(e["input_ids"], F.col(w), pad_id), "labels": padded(e["labels"], F.col(w), IGNORED), "attention_mask": padded(seen, F.col(w), 0)}
    return wide.withColumns(made).drop(n, w, example_column)
