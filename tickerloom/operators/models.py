"""Entity and market-impact models: optional user functions, filtered and joined in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.probability import rounded
from tickerloom.functions.text import keyword_impact
from tickerloom.params import DEFAULTS, Params
from tickerloom.schemas import ENTITY

# Text in, mentions out: {text, entity_type, confidence, start_char, end_char}.
EntityFn = Callable[[str], Sequence[Mapping[str, object]]]
# Text in, best label out: a phrase naming high, medium or low impact.
ImpactFn = Callable[[str], str]

# The same for lists: one answer per text, in order.
EntityBatchFn = Callable[[Sequence[str]], Sequence[Sequence[Mapping[str, object]]]]
ImpactBatchFn = Callable[[Sequence[str]], Sequence[str]]
BATCH_SIZE = 32

_MENTIONS = pa.list_(
    pa.struct(
        [
            ("text", pa.string()), ("entity_type", pa.string()), ("confidence", pa.float64()),
            ("start_char", pa.int32()), ("end_char", pa.int32()),
        ]
    )
)


def answers(model_fn: Callable[[list[str]], Sequence], texts: list[str], size: int, failed: object) -> list:
    """One answer per text, asked for `size` texts at a time; `failed` where the model fails.

    A batch that fails, or has another number of answers, is halved until the texts at fault are
    alone, so one bad text costs its neighbours nothing.
    """
    out: list = []
    waiting = [texts[at : at + size] for at in range(0, len(texts), size)][::-1]
    while waiting:
        batch = waiting.pop()
        try:
            found = list(model_fn(batch))
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} answers for {len(batch)} texts")
        except Exception:
            if len(batch) == 1:
                out.append(failed)
            else:
                middle = len(batch) // 2
                waiting += [batch[middle:], batch[:middle]]
        else:
            out += found
    return out


def asked_in_batches(
    values: pa.Array, asked: pa.Array, model_fn: Callable[[list[str]], Sequence], size: int, failed: object,
    kind: pa.DataType, unasked: object = None,
) -> pa.Array:
    """`answers` for the texts of an array where `asked` holds, `unasked` for the others.

    Texts become Python objects `size` at a time and their answers an array at once, so objects of a few
    texts are alive, however many an Arrow batch holds.
    """
    given = np.flatnonzero(np.asarray(asked))
    place = np.full(len(values), len(given))
    place[given] = np.arange(len(given))
    told = []
    for at in range(0, len(given), size):
        texts = values.take(pa.array(given[at : at + size])).to_pylist()
        told.append(pa.array(answers(model_fn, texts, size, failed), kind))
    return pa.concat_arrays([*told, pa.array([unasked], kind)]).take(pa.array(place))


def keep_confident(entities: Column, min_score: float) -> Column:
    """Mentions scored above the bound, scores to 4 places."""
    kept = F.filter(entities, lambda e: e["confidence"] > min_score)
    return F.transform(
        kept, lambda e: e.withField("confidence", rounded(e["confidence"], 4))
    )


def _one_model(model_fn: object, batch_fn: object, batch_size: int) -> None:
    if model_fn is not None and batch_fn is not None:
        raise ValueError("give a model for one text or one for lists, not both")
    if batch_size < 1:
        raise ValueError(f"a batch holds at least one text, got {batch_size}")


def with_entities(
    articles: DataFrame,
    model_fn: EntityFn | None = None,
    params: Params = DEFAULTS,
    batch_fn: EntityBatchFn | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add `entities` found in the headline; none for a blank one or where the model fails.

    The model is a function of one text, or `batch_fn` of up to `batch_size` texts at a time.
    """
    _one_model(model_fn, batch_fn, batch_size)
    kind = T.ArrayType(ENTITY)
    if model_fn is None and batch_fn is None:
        return articles.withColumn("entities", F.array().cast(kind))
    fields = ENTITY.fieldNames()

    ask = batch_fn if batch_fn is not None else lambda texts: [model_fn(text) for text in texts]

    def mentions(texts: list[str]) -> list[list[dict]]:
        return [[{f: m[f] for f in fields} for m in told] for told in ask(texts)]

    size = batch_size if batch_fn is not None else 1

    @F.arrow_udf(kind)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            asked = pc.greater(pc.fill_null(pc.binary_length(batch), 0), 0)
            yield asked_in_batches(batch, asked, mentions, size, failed=[], kind=_MENTIONS, unasked=[])

    raw = articles.withColumn("entities", found("headline"))
    return raw.withColumn("entities", keep_confident(F.col("entities"), params.entity_min_score))


def with_impact_fallback(
    articles: DataFrame,
    model_fn: ImpactFn | None = None,
    batch_fn: ImpactBatchFn | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add `fallback_impact`, asking the model only where no keyword decides; null elsewhere.

    Spark does not skip a Python function under a conditional expression, so decided rows go to
    Python as nulls, which cost nothing there. The step stays row-local: no join back.
    `batch_fn` takes up to `batch_size` undecided texts at a time.
    """
    _one_model(model_fn, batch_fn, batch_size)
    if model_fn is None and batch_fn is None:
        return articles.withColumn("fallback_impact", F.lit(None).cast("string"))

    def named(label: str) -> str:
        return next((name for name in ("high", "medium") if name in label), "low")

    ask = batch_fn if batch_fn is not None else lambda texts: [model_fn(text) for text in texts]
    size = batch_size if batch_fn is not None else 1

    def levels(texts: list[str]) -> list[str]:
        return [named(label) for label in ask(texts)]

    @F.arrow_udf(T.StringType())
    def asked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield asked_in_batches(batch, pc.is_valid(batch), levels, size, failed="unknown", kind=pa.string())

    headline = F.col("headline")
    undecided = F.when(keyword_impact(headline).isNull(), headline)
    return articles.withColumn("fallback_impact", asked(undecided))
