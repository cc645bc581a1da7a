"""Small user models that show the model hooks; word counts, not classifiers of any quality."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from tickerloom.operators.scoring import ModelFn, register_model

_UP = ("rise", "beats", "record", "surge", "growth")
_DOWN = ("crash", "miss", "fades", "cut", "flat")
_NAME = re.compile(r"[A-Z]{2,5}")


def _count(text: str, terms: Sequence[str]) -> int:
    return sum(text.count(t) for t in terms)


def _load(floor: int, capital: bool) -> ModelFn:
    def score(texts: Sequence[str]) -> list[Mapping[str, float]]:
        out = []
        for text in texts:
            up, down = _count(text, _UP) + floor, _count(text, _DOWN) + floor
            total = up + down + 1
            labels = ("Positive", "Negative", "LABEL_9") if capital else (
                "positive", "negative", "neutral"
            )
            out.append(dict(zip(labels, (up / total, down / total, 1 / total))))
        return out

    return score


MODELS = register_model((), "primary", 0.5, lambda: _load(1, False))
MODELS = register_model(MODELS, "secondary", 0.3, lambda: _load(2, True))
MODELS = register_model(MODELS, "tertiary", 0.2, lambda: _load(3, False))


def entities(text: str) -> list[dict[str, object]]:
    """Runs of capitals; the longer the run, the surer."""
    return [
        {
            "text": m.group(), "entity_type": "ORG", "confidence": 0.6 + 0.1 * len(m.group()),
            "start_char": m.start(), "end_char": m.end(),
        }
        for m in _NAME.finditer(text)
    ]


def impact(text: str) -> str:
    return "high market impact" if "names new" in text else "low market impact"


def entities_of_all(texts: Sequence[str]) -> list[list[dict[str, object]]]:
    return [entities(text) for text in texts]


def impact_of_all(texts: Sequence[str]) -> list[str]:
    return [impact(text) for text in texts]
