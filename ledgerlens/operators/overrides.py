"""A model's say over rule results: batched, allowed to fail, and never the reason that a job fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: the reason code of a classifier that failed. Rows that a model is asked about at once.
FAILED, BATCH = "model_classifier_failed", 64
#: Takes texts and the reason codes of the rules; for each row a decision and its reason codes, or None to leave it to the rules.
Classifier = Callable[[list[str], list[list[str]]], list[tuple[str, list[str]] | None]]


def _asked(classify: Classifier, texts: list[str], reasons: list[list[str]]) -> list[tuple[tuple | None, str | None]]:
    """(answer, error) for each row. A batch that fails is halved, so that only rows that fail by themselves have an error."""
    try:
        answers = classify(texts, reasons)
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
        return [(a, None) for a in answers]
    except Exception as e:  # noqa: BLE001  whatever a model does, its rows fall back
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return _asked(classify, texts[:half], reasons[:half]) + _asked(classify, texts[half:], reasons[half:])


def overridden(gated: DataFrame, classify: Classifier, batch: int = BATCH) -> DataFrame:
    """gated (text, decision, reasons and more) after a classifier: decision, reasons, by (model or rules) and error.

    A row that fails keeps the decision of the rules, with FAILED after their reasons; a null answer keeps both as they are.
    """
    kind = T.StructType([*gated.schema.fields, T.StructField("by", T.StringType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), batch):
                b = whole.slice(first, batch)
                texts = [x or "" for x in b.column("text").to_pylist()]
                decisions, reasons = b.column("decision").to_pylist(), [x or [] for x in b.column("reasons").to_pylist()]
                out = {"decision": [], "reasons": [], "by": [], "error": []}
                for decision, own, (answer, error) in zip(decisions, reasons, _asked(classify, texts, reasons), strict=True):
                    out["decision"].append(answer[0] if answer else decision)
                    out["reasons"].append(list(answer[1]) if answer else [*own, FAILED] if error else own)
                    out["by"].append("model" if answer else "rules")
                    out["error"].append(error)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else b.column(f.name) for f in arrow], schema=arrow)

    return gated.mapInArrow(run, kind)


def report(rows: DataFrame) -> DataFrame:
    """by, error (its kind), rows."""
    return rows.groupBy("by", F.substring_index("error", ":", 1).alias("error")).agg(F.count("*").alias("rows"))
