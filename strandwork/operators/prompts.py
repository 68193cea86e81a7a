"""Texts that describe a row to a language model, and the call itself with a transport that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt(lines: dict[str, Column], question: str | None = None) -> Column:
    """`name: value` lines in the given order, those with a null value left out, then the question after an empty line."""
    each = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in lines.items()]
    text = F.array_join(F.filter(F.array(*each), lambda x: x.isNotNull()), "\n")
    return text if question is None else F.concat(text, F.lit(f"\n\n{question}"))


def prediction_lines(predictions: dict[str, Column]) -> dict[str, Column]:
    """Lines of predictions (structs of label and confidence) for prompt()."""
    return {k.replace("_", " ").capitalize(): F.format_string("%s (%.1f%% confidence)", p["label"], p["confidence"] * 100) for k, p in predictions.items()}


def answer(rows: DataFrame, send: Callable[[str], str], text: str = "prompt") -> DataFrame:
    """rows with response, success and error: `send` is called on the executors, once per row; an error becomes a row, not a failure."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())])

    def run(batches):
        for b in batches:
            said, fine, wrong = [], [], []
            for t in b[text]:
                try:
                    said.append(send(t))
                    fine.append(True)
                    wrong.append(None)
                except Exception as e:  # noqa: BLE001  (whatever the transport raises belongs to its row)
                    said.append(None)
                    fine.append(False)
                    wrong.append(f"{type(e).__name__}: {e}")
            yield b.assign(response=said, success=fine, error=wrong)

    return rows.mapInPandas(run, schema)
