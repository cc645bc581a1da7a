"""Record schemas; wire and table forms derive from these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _B, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ENTITY = _struct(
    text=_S, entity_type=_S, confidence=_D, start_char=T.IntegerType(), end_char=T.IntegerType()
)

MODEL_PREDICTION = _struct(
    model_name=_S, sentiment=_S, positive_prob=_D, negative_prob=_D, neutral_prob=_D,
    latency_ms=_D,
)

RAW_ARTICLE = _struct(
    source=_S, headline=_S, url=_S, published_at=_TS, body=_S, author=_S, content_hash=_S
)

# The message as it travels: time as ISO text, body and author optional.
RAW_ARTICLE_WIRE = _struct(
    source=_S, headline=_S, url=_S, published_at=_S, body=_S, author=_S, content_hash=_S
)

MODEL_SCORES = _struct(
    article_hash=_S, model_ix=T.IntegerType(), positive_prob=_D, negative_prob=_D,
    neutral_prob=_D, latency_ms=_D,
)

SENTIMENT_RESULT = _struct(
    article_hash=_S, headline=_S, url=_S, source=_S, published_at=_TS, processed_at=_TS,
    ensemble_sentiment=_S, ensemble_confidence=_D, ensemble_uncertainty=_D,
    positive_prob=_D, negative_prob=_D, neutral_prob=_D,
    model_predictions=T.ArrayType(MODEL_PREDICTION), entities=T.ArrayType(ENTITY),
    tickers=T.ArrayType(_S), sectors=T.ArrayType(_S),
    is_forward_looking=_B, has_negation=_B, hedge_score=_D, market_impact=_S,
    is_uncertain=_B, temperature_scaled=_B,
)

# 32-bit floats and ISO times appear only on the wire.
SENTIMENT_RESULT_WIRE = _struct(
    article_hash=_S, headline=_S, url=_S, source=_S, published_at=_S, processed_at=_S,
    ensemble_sentiment=_S, ensemble_confidence=T.FloatType(),
    ensemble_uncertainty=T.FloatType(), positive_prob=T.FloatType(),
    negative_prob=T.FloatType(), neutral_prob=T.FloatType(), tickers=T.ArrayType(_S),
    sectors=T.ArrayType(_S), is_forward_looking=_B, has_negation=_B,
    hedge_score=T.FloatType(), market_impact=_S, is_uncertain=_B,
)

# What a missing or null value means.
_DEFAULTS = {
    "body": "", "author": "", "is_forward_looking": False, "has_negation": False,
    "hedge_score": 0.0, "market_impact": "unknown", "is_uncertain": False,
    "temperature_scaled": True,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema: cast what is there, fill defaults, null for the rest."""
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in _DEFAULTS:
            value = F.coalesce(value, F.lit(_DEFAULTS[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
