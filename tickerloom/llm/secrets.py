"""Secrets in texts: known shapes, and strings whose characters look drawn at random."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.arrays import let, running

#: Fixed patterns, Java syntax: (?i) covers A-Z and a-z only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")


@dataclass(frozen=True)
class CharClass:
    """Strings made of `alphabet` only are judged by the entropy, in bits, of `window` characters."""

    name: str
    pattern: str
    window: int
    least_bits: float


@dataclass(frozen=True)
class EntropyRules:
    """Candidates are runs of letters, digits and `+/_=-` of `shortest` or more characters that
    hold a digit and a letter. The first class that a candidate fits judges it. A candidate that an
    `allowed` pattern matches as a whole is let pass."""

    shortest: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("hex", r"^[0-9a-fA-F-]+$", 24, 3.2),
        CharClass("alnum", r"^[A-Za-z0-9]+$", 20, 3.7),
        CharClass("base64", r"^[A-Za-z0-9+/_=-]+$", 20, 3.7),
    )
    allowed: tuple[str, ...] = field(
        default=(
            # UUIDs, dates and times, versions and numbers, words joined by signs, paths of words.
            r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
            r"^[0-9TZ:+_=/-]+$",
            r"^[vV]?[0-9]+([_-][0-9A-Za-z]{1,8})+$",
            r"^[A-Za-z]+([_/=+-]+[A-Za-z]+)*[_/=+-]*[0-9]{0,4}$",
            r"^[A-Za-z]+([_/=+-]+([A-Za-z]+|[0-9]{1,4}))*[_/=+-]*$",
        )
    )

    @property
    def pattern(self) -> str:
        return rf"[A-Za-z0-9+/_=-]{{{self.shortest},}}+"


def _spans(text: Column, pattern: str, kind: int, possible: Column, keep) -> Column:
    """Spans of the matches for which `keep(match)` holds, in code points.

    Matches and the gaps between them come from two scans of the text; their lengths give the
    places. `possible` is a cheap test that every text with a match passes; most texts fail it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(matches: Column) -> Column:
        lengths = F.flatten(
            F.zip_with(
                F.split(text, pattern, -1),
                matches,
                lambda g, m: F.array(F.char_length(g), F.coalesce(F.char_length(m), F.lit(0))),
            )
        )
        listed = lambda at: F.transform(
            matches,
            lambda m, i: F.struct(
                F.element_at(at, 2 * i + 2).alias("start"),
                F.lit(kind).alias("kind"),
                F.element_at(at, 2 * i + 3).alias("end"),
                m.alias("m"),
            ),
        )
        chosen = F.filter(let(let(lengths, lambda x: running(x, F.lit(0), lambda a, b: a + b)), listed), lambda s: keep(s["m"]))
        return F.transform(chosen, lambda s: F.struct(s["start"], s["kind"], s["end"]))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(possible, let(found, placed)).otherwise(empty)


def window_entropy(candidate: Column, window: int) -> Column:
    """Highest Shannon entropy, in bits per character, of `window` consecutive characters.

    Counts are kept as the window slides: one character enters, one leaves, and only their terms of
    sum(c log2 c) change. A shorter candidate is one window.
    """
    return let(F.split(candidate, ""), lambda chars: _slide(chars, window))


def _slide(chars: Column, window: int) -> Column:
    size = F.least(F.size(chars), F.lit(window))
    symbols = F.array_distinct(chars)
    places = F.transform(chars, lambda c: F.array_position(symbols, c).cast("int"))
    lowest = let(places, lambda p: _lowest_sum(p, size))
    return F.log2(size.cast("double")) - lowest / size


def _lowest_sum(places: Column, size: Column) -> Column:
    """Least sum of c log2 c over the windows; `places` numbers the distinct characters from 1."""
    term = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    zero = F.struct(
        F.transform(F.sequence(F.lit(1), F.array_max(places)), lambda _: F.lit(0.0)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(None).cast("double").alias("lowest"),
    )

    def step(state: Column, i: Column) -> Column:
        enters = F.element_at(places, i)
        leaves = F.when(i > size, F.element_at(places, F.greatest(i - size, F.lit(1))))
        grown = F.element_at(state["counts"], enters)
        shrunk = F.element_at(state["counts"], leaves)
        total = F.when(leaves.eqNullSafe(enters), state["total"]).otherwise(
            state["total"] + term(grown + 1) - term(grown)
            + F.when(leaves.isNull(), 0.0).otherwise(term(shrunk - 1) - term(shrunk))
        )
        counts = F.transform(
            state["counts"],
            lambda c, j: c
            + F.when(j + 1 == enters, 1.0).otherwise(0.0)
            - F.when(leaves.eqNullSafe(j + 1), 1.0).otherwise(0.0),
        )
        lowest = F.when(i >= size, F.least(state["lowest"], total)).otherwise(state["lowest"])
        return F.struct(counts.alias("counts"), total.alias("total"), lowest.alias("lowest"))

    return F.aggregate(F.sequence(F.lit(1), F.size(places)), zero, step, lambda s: s["lowest"])


def _random_looking(rules: EntropyRules):
    def keep(m: Column) -> Column:
        allowed = F.lit(False)
        for pattern in rules.allowed:
            allowed = allowed | m.rlike(pattern)
        verdict = F.lit(False)
        for c in reversed(rules.classes):
            verdict = F.when(m.rlike(c.pattern), F.round(window_entropy(m, c.window), 9) >= c.least_bits).otherwise(verdict)
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        return F.when(~mixed | allowed, False).otherwise(verdict)

    return keep


def secret_spans(text: Column, rules: EntropyRules = EntropyRules()) -> Column:
    """array<struct<start, kind, end>> by start, then kind; `kind` is an index into KINDS."""
    text = F.coalesce(text, F.lit(""))
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 8
    every = lambda m: F.lit(True)
    hex_run = r"[0-9a-f]{32,}"
    base = [
        # Every keyword ends in one of these letters, and a sign follows.
        _spans(text, ASSIGN, 0, text.rlike(r"""[dtnyDTNY]["']?\x20*[:=]"""), long_value),
        # A run that is too short cannot hold a longer one, so the bound may be in the pattern.
        _spans(text, r"AKIA[A-Z0-9]{12,}", 1, text.contains("AKIA"), every),
        _spans(text, hex_run, 2, text.rlike(hex_run), every),
        # A string of letters and digits has a place where one meets the other.
        _spans(
            text, rules.pattern, 3, text.rlike(r"[0-9](?:[A-Za-z+/_=-]|(?<=[A-Za-z+/_=-][0-9]))"), _random_looking(rules)
        ),
    ]
    return F.array_sort(F.concat(*base))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """(id, spans array, n_assign, n_access, n_hex, n_entropy, base_listing, listing) per row.

    One narrow pass, no shuffle. Null and empty texts have no spans; each repeated row is scanned.
    Spans of different kinds may overlap; those of one kind do not.
    """
    found = docs.select(F.col(id_col), secret_spans(F.col("text"), rules).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        "spans",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        _listing(F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))).alias("base_listing"),
        _listing(F.col("spans")).alias("listing"),
    )


def redact(docs: DataFrame, rules: EntropyRules = EntropyRules(), mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; every stretch of the text under a span is replaced by one mark.

    Overlapping or touching spans are one stretch. A text without spans, a null one too, is returned
    as it is; `n_chars`, where there is such a column, follows a changed text.
    """
    text = F.col("text")
    before = lambda s, e: F.substring(text, s + 1, e - s)
    # Fold the sorted spans: pieces written so far, and the end of the stretch that is open.
    opened = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("end"))

    def step(state: Column, s: Column) -> Column:
        apart = (s["start"] > state["end"]) | (F.size(state["out"]) == 0)
        out = F.when(
            apart, F.concat(state["out"], F.array(before(state["end"], s["start"]), F.lit(mark)))
        ).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["end"], s["end"]).alias("end"))

    def close(state: Column) -> Column:
        tail = F.substring(text, state["end"] + 1, F.char_length(text))
        return F.concat(F.array_join(state["out"], ""), tail)

    # Two working columns, under names that the table does not have.
    taken = max(map(len, docs.columns), default=0)
    held, made = "s" * (taken + 1), "t" * (taken + 1)
    spans = F.col(held)
    changed = F.when(F.size(spans) > 0, F.aggregate(spans, opened, step, close)).otherwise(text)
    out = docs.withColumn(held, secret_spans(text, rules)).withColumn(made, changed)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col(made).alias("text"))
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            columns.append(
                F.when(F.size(held) > 0, F.char_length(made).cast(kind)).otherwise(F.col(name)).alias(name)
            )
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns)
