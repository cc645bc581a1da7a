"""DuckDB statements that must give the same rows as the registered queries."""

from __future__ import annotations

import math

from tickerloom.functions import vocab
from tickerloom.functions.vocab import E2E_BUCKETS, PRODUCE_BUCKETS
from tickerloom.plans.views import ARRIVAL_SPAN, PHRASES

_WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]"
)


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _h(*parts: str) -> str:
    return "cast('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8) as bigint)"


def _r(expr: str, places: int = 6) -> str:
    return f"round_even(cast({expr} as double), {places})"


def _rs(*columns: str) -> str:
    return ", ".join(f"{_r(c)} as {c}" for c in columns)


def _iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')"


def _argmax(a: str, b: str, c: str) -> str:
    return f"case when {a} >= {b} and {a} >= {c} then 0 when {b} >= {c} then 1 else 2 end"


_NAMES = _list(vocab.SENTIMENTS)


def _name(ix: str) -> str:
    return f"{_NAMES}[({ix}) + 1]"


def _bin(x: str, bins: int, op: str = ">=") -> str:
    step = 1.0 / bins
    return " + ".join(f"cast({x} {op} cast('{k * step!r}' as double) as int)" for k in range(1, bins))


# --- common tables -------------------------------------------------------------------------------

_ARTICLES = f"""
articles as materialized (
  select *, substr(sha256(headline || url), 1, 16) as content_hash,
         trim(headline || ' ' || body, chr(32) || chr(9) || chr(10) || chr(13)) as full_text
  from (select doc_id, source, '' as author,
               {_list(PHRASES)}[doc_id % 12 + 1] || ' ' || text as headline,
               {_list(PHRASES)}[(doc_id // 12) % 12 + 1] as body,
               'doc://' || source || '/' || doc_id as url,
               timestamp '2024-01-01 00:00:00' + to_seconds(doc_id * 20) as published_at
        from documents))
"""


def _drawn(key: str, tail: str = "") -> str:
    return ", ".join(
        f"1 + {_h('doc_id', key, chr(39) + c + chr(39), *([tail] if tail else []))} % 1000 as u{i}"
        for i, c in enumerate(("pos", "neg", "neu"))
    )


_SCORES = f"""
scores as materialized (
  select doc_id, article_hash, model_ix, latency_ms, u0 / (u0 + u1 + u2) as positive_prob,
         u1 / (u0 + u1 + u2) as negative_prob, u2 / (u0 + u1 + u2) as neutral_prob
  from (select doc_id, content_hash as article_hash, model_ix, {_drawn('model_ix')},
               10 + {_h('doc_id', 'model_ix', "'l'")} % 140 as latency_ms
        from articles, (select unnest(range(3)) as model_ix)))
"""
_PASSES = f"""
passes as materialized (
  select article_hash, pass, u0 / (u0 + u1 + u2) as p0, u1 / (u0 + u1 + u2) as p1,
         u2 / (u0 + u1 + u2) as p2
  from (select content_hash as article_hash, pass, {_drawn('pass', "'mc'")}
        from articles, (select unnest(range(10)) as pass)))
"""
_W = "case model_ix when 0 then 0.5e0 when 1 then 0.3e0 else 0.2e0 end"
_PREDICTED = f"""
averaged as (
  select article_hash, sum({_W} * positive_prob) as q0, sum({_W} * negative_prob) as q1,
         sum({_W} * neutral_prob) as q2,
         list({_argmax('positive_prob', 'negative_prob', 'neutral_prob')} order by model_ix) as preds
  from scores group by article_hash),
scaled as (
  select article_hash, preds, (q0 + 1e-9) / t as positive_prob, (q1 + 1e-9) / t as negative_prob,
         (q2 + 1e-9) / t as neutral_prob
  from (select *, q0 + q1 + q2 + 3e-9 as t from averaged)),
mc as (
  select article_hash, -(m0 * ln(m0) + m1 * ln(m1) + m2 * ln(m2)) / ln(3) as ensemble_uncertainty
  from (select article_hash, avg(p0) as m0, avg(p1) as m1, avg(p2) as m2
        from passes group by article_hash)),
predicted as materialized (
  select s.*, {_argmax('positive_prob', 'negative_prob', 'neutral_prob')} as y_pred,
         {_name(_argmax('positive_prob', 'negative_prob', 'neutral_prob'))} as ensemble_sentiment,
         greatest(positive_prob, negative_prob, neutral_prob) as ensemble_confidence,
         ensemble_uncertainty, ensemble_uncertainty > 0.99 as is_uncertain
  from scaled s join mc using (article_hash))
"""

# RE2 has no look-around and its word boundary is ASCII: other letters become 'a' first.
_PLAIN = r"regexp_replace(regexp_replace({t}, '[^\x00-\x7F\pL\pN]', ' ', 'g'), '[^\x00-\x7F]', 'a', 'g')"


def _plain(t: str) -> str:
    return _PLAIN.replace("{t}", t)


_FORWARD = vocab.FORWARD_LOOKING_TERMS.replace("{ws}", r"\s").replace("{ws_in}", r"\s").replace(
    r"\p{Nd}", r"\d"
)
_SECTOR_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.TICKER_SECTORS.items()) + "}"
_FIRST = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def _ordered_distinct(expr: str) -> str:
    return _FIRST.replace("{l}", expr)


def _any(text: str, terms) -> str:
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_KEYWORD = (
    f"case when {_any('lower(headline)', vocab.HIGH_IMPACT)} then 'high' "
    f"when {_any('lower(headline)', vocab.MEDIUM_IMPACT)} then 'medium' end"
)
_FEATURES = f"""
worded as materialized (
  select *, list_filter(regexp_split_to_array(lower(full_text), '{_WS}+'), lambda w: w <> '') as words,
         list_filter(regexp_extract_all({_plain('full_text')}, '\\b([A-Z]{{1,5}})\\b', 1),
           lambda t: length(t) >= 2 and not list_contains({_list(vocab.TICKER_BLOCKLIST)}, t)) as found
  from articles),
tickered as materialized (select *, {_ordered_distinct('found')} as tickers from worded),
sectored as (
  select *, list_filter(list_transform(tickers, lambda t: {_SECTOR_MAP}[t]),
                        lambda s: s is not null) as all_sectors from tickered),
features as materialized (
  select *, {_ordered_distinct('all_sectors')} as sectors,
    regexp_matches({_plain('full_text')}, '(?i)\\b(?:{_FORWARD})\\b') as is_forward_looking,
    list_has_any(words, {_list(vocab.NEGATION_WORDS)}) as has_negation,
    case when len(words) = 0 then 0 else
      len(list_filter(words, lambda w: list_contains({_list(vocab.HEDGE_WORDS)}, w))) / len(words)
    end as hedge_score,
    coalesce({_KEYWORD}, 'unknown') as market_impact
  from sectored)
"""
_RESULTS = f"""
results as materialized (
  select doc_id, content_hash as article_hash, headline, url, source, published_at,
         published_at + to_seconds(5) as processed_at, tickers, sectors, is_forward_looking,
         has_negation, hedge_score, market_impact, p.* exclude (article_hash)
  from features f join predicted p on f.content_hash = p.article_hash),
now as (select max(published_at) as as_of from results)
"""
_EVAL = f"""
eval_rows as materialized (
  select article_hash,
         cast(case when {_h('doc_id', "'t'")} % 10 < 7 then y_pred
              else {_h('doc_id', "'u'")} % 3 end as int) as y_true, y_pred,
         positive_prob as p0, negative_prob as p1, neutral_prob as p2, preds,
         ensemble_uncertainty as uncertainty,
         cast(10 + {_h('doc_id', "'l'")} % 140 as double) as latency_ms
  from results)
"""


def _with(body: str, *tables: str) -> str:
    return "with " + ", ".join(t.strip() for t in tables) + "\n" + body


_RES = (_ARTICLES, _SCORES, _PASSES, _PREDICTED, _FEATURES, _RESULTS)
_EV = (*_RES, _EVAL)


def _art(body: str) -> str:
    return _with(body, _ARTICLES)


def _feat(body: str) -> str:
    return _with(body, _ARTICLES, _FEATURES)


def _sco(body: str, *more: str) -> str:
    return _with(body, _ARTICLES, _SCORES, *more)


def _res(body: str, *more: str) -> str:
    return _with(body, *_RES, *more)


def _eva(body: str, *more: str) -> str:
    return _with(body, *_EV, *more)


_JOIN = "array_to_string({0}, ',') as {0}"
_TK, _SE = _JOIN.format("tickers"), _JOIN.format("sectors")
_BRIEF = (
    f"article_hash, url, source, {_iso('published_at')} as published_at, ensemble_sentiment, "
    f"{_rs('ensemble_confidence', 'ensemble_uncertainty')}, {_TK}, market_impact, is_uncertain"
)
_NEWEST = "order by published_at desc, article_hash limit"

_HOURLY = """
rollup as (
  select date_trunc('hour', published_at) as bucket, source, ensemble_sentiment,
         count(*) as article_count, avg(ensemble_confidence) as avg_confidence,
         avg(ensemble_uncertainty) as avg_uncertainty, avg(positive_prob) as avg_positive,
         avg(negative_prob) as avg_negative, avg(neutral_prob) as avg_neutral,
         avg(hedge_score) as avg_hedge
  from results group by all)
"""
_HOURLY_OUT = (
    f"select {_iso('bucket')} as bucket, source, ensemble_sentiment, article_count, "
    + _rs("avg_confidence", "avg_uncertainty", "avg_positive", "avg_negative", "avg_neutral",
          "avg_hedge")
    + " from rollup"
)


def _shares(n: str = "count(*)") -> str:
    pos = "count(*) filter (ensemble_sentiment = 'positive')"
    neg = "count(*) filter (ensemble_sentiment = 'negative')"
    return (
        f"{_r(f'{pos} / {n}', 4)} as positive_pct, {_r(f'{neg} / {n}', 4)} as negative_pct, "
        f"{_r(f'({n} - {pos} - {neg}) / {n}', 4)} as neutral_pct, "
        f"{_r('avg(ensemble_confidence)', 4)} as avg_confidence"
    )


def _ticker_rows(ticker: str, hours: int) -> str:
    return (
        f"(select results.* from results, now where list_contains(tickers, '{ticker}') and "
        f"published_at >= as_of - interval {hours} hour {_NEWEST} 200)"
    )


def _whole(statement: str, ticker: str, hours: int) -> str:
    """The statement over all mentions instead of the newest."""
    rows = _ticker_rows(ticker, hours)
    return statement.replace(rows, rows.replace(f" {_NEWEST} 200)", ")"))


def _histogram(buckets) -> str:
    rows = " union all ".join(
        f"select '{b:.3f}' as le, count(*) filter (value / 10 <= {b!r}::double) as cumulative_count from events"
        for b in buckets
    )
    return rows + " union all select 'Infinity' as le, count(value) as cumulative_count from events"


# --- evaluation ------------------------------------------------------------------------------------

_K = range(3)
_CELLS = "cells as (select " + ", ".join(
    f"count(*) filter (y_true = {t} and y_pred = {p}) as c{t}{p}" for t in _K for p in _K
) + " from eval_rows)"


def _sup(k: int) -> str:
    return "(" + " + ".join(f"c{k}{p}" for p in _K) + ")"


def _pre(k: int) -> str:
    return "(" + " + ".join(f"c{t}{k}" for t in _K) + ")"


_N = "(" + " + ".join(_sup(k) for k in _K) + ")"
_RIGHT = "(c00 + c11 + c22)"


def _div(a: str, b: str, other: str = "0") -> str:
    return f"(case when {b} <> 0 then ({a}) / ({b}) else {other} end)"


def _f1(k: int) -> str:
    return _div(f"2 * c{k}{k}", f"{_sup(k)} + {_pre(k)}")


_AGREE = "(" + " + ".join(f"{_sup(k)} * {_pre(k)}" for k in _K) + ")"
_T2 = "(" + " + ".join(f"{_sup(k)} * {_sup(k)}" for k in _K) + ")"
_P2 = "(" + " + ".join(f"{_pre(k)} * {_pre(k)}" for k in _K) + ")"
_SUMMARY = (
    "summary as (select "
    f"{_N} as n_samples, {_RIGHT} / {_N} as accuracy, "
    + _div(" + ".join(_f1(k) for k in _K),
           " + ".join(f"cast({_sup(k)} + {_pre(k)} > 0 as int)" for k in _K).join("()"))
    + f" as macro_f1, {_RIGHT} / {_N} as micro_f1, "
    + "(" + " + ".join(f"{_f1(k)} * {_sup(k)}" for k in _K) + f") / {_N} as weighted_f1, "
    + _div(f"{_RIGHT} * {_N} - {_AGREE}", f"sqrt(({_N} * {_N} - {_P2})::double * ({_N} * {_N} - {_T2}))")
    + " as mcc, "
    + _div(f"{_RIGHT} / {_N} - {_AGREE} / ({_N} * {_N})", f"(1 - {_AGREE} / ({_N} * {_N}))", "null")
    + " as cohen_kappa from cells)"
)
_CLASSES = "classes as (" + " union all ".join(
    f"select {k} as class_ix, '{s}' as class_name, {_div(f'c{k}{k}', _pre(k))} as \"precision\", "
    f"{_div(f'c{k}{k}', _sup(k))} as recall, {_f1(k)} as f1, {_sup(k)} as support, "
    f"{_sup(k)} / {_N} as share from cells"
    for k, s in enumerate(vocab.SENTIMENTS)
) + ")"
_CONF = "greatest(p0, p1, p2)"
_ECE = f"""
bins as (
  select {_bin(_CONF, 15)} as bin, count(*) as n,
         avg(cast(({_argmax('p0', 'p1', 'p2')}) = y_true as int)) as accuracy,
         avg({_CONF}) as mean_confidence
  from eval_rows group by 1),
ece_row as (select sum(n * abs(accuracy - mean_confidence)) / sum(n) as ece from bins)
"""
_BRIER = "(" + " + ".join(f"(cast(y_true = {k} as int) - p{k}) ** 2" for k in _K) + ") / 3"


def _rates(threshold: float) -> str:
    return f"""
rates as (
  select avg({_BRIER}) as brier_score,
         avg(cast(len(list_filter(preds, lambda x: x <> preds[1])) > 0 as int)) as ensemble_disagreement,
         avg(cast(uncertainty > {threshold} as int)) as uncertain_fraction
  from eval_rows)
"""


_RANKS = """
scored as (
  select class_ix, score, sum(hit) as pos, count(*) - sum(hit) as neg
  from (""" + " union all ".join(
    f"select {k} as class_ix, p{k} as score, cast(y_true = {k} as int) as hit from eval_rows"
    for k in _K
) + """) group by all),
swept as (
  select *, sum(pos) over (partition by class_ix order by score desc) as tp,
         sum(neg) over (partition by class_ix order by score desc) as fp,
         sum(pos) over (partition by class_ix) as all_pos,
         sum(neg) over (partition by class_ix) as all_neg
  from scored),
ranks as (
  select class_ix, """ + _NAMES + """[class_ix + 1] as class_name,
         sum(neg * (tp - pos / 2)) / max(all_pos * all_neg) as roc_auc,
         sum(pos * (tp / (tp + fp))) / max(all_pos) as pr_auc
  from swept group by class_ix)
"""
_LATENCY = """
latency as (
  select """ + ", ".join(
    f"{_r(f'quantile_cont(latency_ms, {q})', 2)} as {n}"
    for n, q in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))
) + " from eval_rows)"

_OVERALL = ("macro_f1", "micro_f1", "weighted_f1", "mcc", "cohen_kappa", "accuracy")
_REPORT = (_CELLS, _SUMMARY, _CLASSES, _ECE, _rates(0.15), _RANKS, _LATENCY, "flat as (" + " union all ".join(
    [f"select 'eval/{c}' as metric, {_r(c)} as value from summary" for c in _OVERALL]
    + ["select 'eval/n_samples' as metric, n_samples::double as value from summary",
       f"select 'eval/macro_roc_auc' as metric, {_r('avg(roc_auc)')} as value from ranks",
       f"select 'eval/ece' as metric, {_r('ece')} as value from ece_row",
       f"select 'eval/brier_score' as metric, {_r('brier_score')} as value from rates",
       f"select 'eval/ensemble_disagreement' as metric, {_r('ensemble_disagreement', 4)} as value from rates",
       f"select 'eval/uncertain_fraction' as metric, {_r('uncertain_fraction', 4)} as value from rates"]
    + [f"select 'eval/{c}' as metric, {c} as value from latency" for c in ("p50_ms", "p95_ms", "p99_ms")]
    + [f"select 'eval/' || class_name || '/{c}' as metric, {_r(q)} as value from classes"
       for c, q in (("precision", '"precision"'), ("recall", "recall"), ("f1", "f1"), ("support", "support"))]
    + [f"select 'eval/' || class_name || '/{c}' as metric, {_r(c)} as value from ranks" for c in ("pr_auc", "roc_auc")]
) + ")")
_WIDE = ("macro_f1", "micro_f1", "weighted_f1", "macro_roc_auc", "mcc", "cohen_kappa", "accuracy",
         "ece", "brier_score", "ensemble_disagreement", "uncertain_fraction", "p50_ms", "p95_ms",
         "p99_ms")


def _pick(metric: str, alias: str) -> str:
    return f"max(value) filter (metric = 'eval/{metric}') as \"{alias}\""


def _calibration() -> list[str]:
    """Five passes of a 17-point search for the best ln T, as the engine makes them."""
    low, high = math.log(0.05), math.log(20.0)
    half, centre = (high - low) / 2, f"(select {(high + low) / 2!r}::double as c)"
    tables = [
        "logits as (select y_true, ln(p0 + 1e-9) as z0, ln(p1 + 1e-9) as z1, ln(p2 + 1e-9) as z2 from eval_rows)"
    ]
    for i in range(1, 6):
        spread = " + ".join(f"exp((z{k} - greatest(z0, z1, z2)) / exp(log_t))" for k in _K)
        own = "case y_true when 0 then z0 when 1 then z1 else z2 end"
        tables.append(
            f"pass{i} as (select log_t, nll from (select log_t, "
            f"avg(ln({spread}) + (greatest(z0, z1, z2) - {own}) / exp(log_t)) as nll "
            f"from logits, (select c + {half!r}::double * k / 8 as log_t from {centre}, "
            "(select unnest(range(-8, 9)) as k)) group by log_t) order by nll limit 1)"
        )
        half, centre = half / 8, f"(select log_t as c from pass{i})"
    return tables


# --- drift -------------------------------------------------------------------------------------------


def _drift(ref: str, cur: str, key: str = "") -> tuple[str, ...]:
    """Tables for a drift report between two row sets given as FROM items; for each value of a key, if there is one."""
    own, sets, grouped = (f"{key}, ", f"r join c using ({key})", f" group by {key}") if key else ("", "r, c", "")

    def profile(name: str, rows: str) -> str:
        bins = ", ".join(
            f"greatest(count(*) filter (({_bin('ensemble_confidence', 10)}) = {b}) / count(*), 1e-6) as b{b}"
            for b in range(10)
        )
        labels = ", ".join(
            f"count(*) filter (ensemble_sentiment = '{s}') as l{k}" for k, s in enumerate(vocab.SENTIMENTS)
        )
        return (
            f"{name} as (select {own}count(*) as n, {bins}, {labels}, avg(positive_prob) as q0, "
            f"avg(negative_prob) as q1, avg(neutral_prob) as q2 from {rows}{grouped})"
        )

    psi = " + ".join(f"(c.b{b} - r.b{b}) * ln(c.b{b} / r.b{b})" for b in range(10))
    rl, cl = "(r.l0 + r.l1 + r.l2)", "(c.l0 + c.l1 + c.l2)"
    cells = ", ".join(
        f"greatest(c.l{k}, 1)::double as o{k}, greatest(r.l{k} / {rl} * {cl}, 1) as s{k}" for k in _K
    )
    js = ", ".join(
        f"(r.l{k} / {rl} + 1e-9) / (1 + 3e-9) as x{k}, (c.q{k} + 1e-9) / (c.q0 + c.q1 + c.q2 + 3e-9) as y{k}"
        for k in _K
    )
    o, s = "(o0 + o1 + o2)", "(s0 + s1 + s2)"
    chi2 = " + ".join(
        f"({v}{k} - {t} * (o{k} + s{k}) / ({o} + {s})) ** 2 / ({t} * (o{k} + s{k}) / ({o} + {s}))"
        for k in _K for v, t in (("o", o), ("s", s))
    )
    jsd = " + ".join(
        f"x{k} * ln(x{k} / ((x{k} + y{k}) / 2)) + y{k} * ln(y{k} / ((x{k} + y{k}) / 2))" for k in _K
    )
    return (
        profile("r", ref), profile("c", cur),
        f"parts as (select {own}r.n as reference_rows, c.n as current_rows, {psi} as psi, {cells}, {js} from {sets})",
        f"measured as (select {own}reference_rows, current_rows, psi, exp(-({chi2}) / 2) as p, "
        f"least(({jsd}) / 2, 1) as js from parts)",
        f"report as (select {own}reference_rows, current_rows, "
        f"{_r('psi')} as psi_confidence, {_r('js')} as js_divergence, {_r('p')} as chi2_pvalue, "
        "(psi > 0.2 or p < 0.01 or js > 0.1) as is_drifting, "
        "concat_ws('; ', case when psi > 0.2 then printf('PSI=%.4f > 0.2', psi) end, "
        "case when p < 0.01 then printf('Label drift chi2 p=%.4f', p) end, "
        "case when js > 0.1 then printf('Prediction drift JS=%.4f', js) end) as alerts, "
        "case when psi < 0.1 then 'stable' when psi <= 0.2 then 'moderate' else 'significant' end as psi_band "
        "from measured)",
    )


_BY_IMPACT = _drift("results where market_impact <> 'high'", "results where market_impact = 'high'")
_BY_SURE = _drift("results where ensemble_confidence <= 0.5", "results where ensemble_confidence > 0.5")
_CHECK = _drift(
    "(select results.* from results, now where published_at >= as_of - interval 24 hour)",
    "(select results.* from results, now where published_at >= as_of - interval 1 hour)",
)
_ENDS = "(select distinct date_trunc('hour', published_at) + interval 1 hour as checked_at from results)"
_HOURS = _drift(*[
    f"(select * from results join {_ENDS} on published_at >= checked_at - interval {h} hour and published_at < checked_at)"
    for h in (24, 1)
], "checked_at")
_CHECK_CAPPED = _drift(
    f"(select results.* from results, now where published_at >= as_of - interval 24 hour {_NEWEST} 2000)",
    f"(select results.* from results, now where published_at >= as_of - interval 1 hour {_NEWEST} 500)",
)
_HALVED = """
halved as materialized (
  select *, row_number() over (order by published_at desc, article_hash) as rn, count(*) over () as all_n
  from results)
"""
_HALVES = _drift("halved where rn > all_n // 2", "halved where rn <= all_n // 2")

# --- fingerprints ------------------------------------------------------------------------------------

_RAW = """
raw_docs as materialized (
  select doc_id as ordinal, source, text as headline, substr(sha256(text), 1, 16) as content_hash
  from documents)
"""
_PRINTS = """
letters as (
  select ordinal, content_hash, regexp_replace(lower(headline), '[^\\pL\\pN_]', '', 'g') as s
  from raw_docs),
shingles as (
  select ordinal, substr(s, i, 4) as g, count(*) as w
  from (select ordinal, s, unnest(range(1, greatest(length(s) - 3, 1) + 1)) as i from letters)
  group by all),
hashed as (
  select ordinal, w, cast('0x' || substr(md5(g), 17, 16) as ubigint) as h from shingles),
votes as (
  select ordinal, sum(w) as total, """ + ", ".join(
    f"sum(w * ((h >> {b}) & 1)) as b{b}" for b in range(64)
) + """ from hashed group by ordinal),
prints as materialized (
  select ordinal, """ + " | ".join(
    f"(cast(2 * b{b} > total as ubigint) << {b})" for b in range(64)
) + """ as fp from votes)
"""
_FP = "lpad(lower(hex({0})), 16, '0')"
_ARRIVED = f"""
arrived as materialized (
  select *, ordinal * {ARRIVAL_SPAN} // (select max(ordinal) + 1 from raw_docs) as secs from raw_docs)
"""
_KEPT_IN_WINDOW = """
ordered as materialized (
  select row_number() over (order by r.ordinal) as rn, r.ordinal, r.content_hash, r.secs, fp
  from arrived r join prints using (ordinal)),
walk as (
  select 0::bigint as rn, []::struct(fp ubigint, secs bigint)[] as kept, false as keep
  union all
  select o.rn, case when near then kept else list_append(kept, struct_pack(fp := o.fp, secs := o.secs)) end, not near
  from (select w.rn + 1 as next, w.kept from walk w) s
  join ordered o on o.rn = s.next,
  lateral (select len(list_filter(
    s.kept, lambda k: o.secs - k.secs < 86400 and bit_count(xor(k.fp, o.fp)) < 4)) > 0 as near))
"""
_FIRST_IN_WINDOW = """
firsts as (
  select content_hash, min(ordinal) as ordinal, min(secs) as secs from arrived group by 1
  union all
  select r.content_hash, min(r.ordinal), min(r.secs) from firsts f
  join arrived r on r.content_hash = f.content_hash and r.secs >= f.secs + 86400
  group by r.content_hash)
"""
_FETCHED = """
raw_docs as materialized (
  select *, row_number() over (order by rank, payload_id, pos) as ordinal
  from (select rank, payload_id, pos, source, headline, url, published_at, body, author, content_hash from newsapi
        union all
        select rank, payload_id, pos, source, headline, url, published_at, body, author, content_hash from rss
        union all
        select rank, payload_id, pos, source, headline, url,
               published_at, body, author, content_hash from av))
"""
_KEPT = """
ordered as materialized (
  select row_number() over (order by ordinal) as rn, ordinal, content_hash, fp
  from (select r.ordinal, r.content_hash, fp,
               row_number() over (partition by content_hash order by r.ordinal) as copy
        from raw_docs r join prints using (ordinal)) where copy = 1),
walk as (
  select 0::bigint as rn, []::ubigint[] as kept, false as keep
  union all
  select o.rn, case when near then kept else list_append(kept, o.fp) end, not near
  from (select w.rn + 1 as next, w.kept from walk w) s
  join ordered o on o.rn = s.next,
  lateral (select len(list_filter(s.kept, lambda k: bit_count(xor(k, o.fp)) < 4)) > 0 as near))
"""

# --- sources -----------------------------------------------------------------------------------------

_HASHED = "substr(sha256(headline || url), 1, 16) as content_hash"
_PID = "lpad(doc_id::varchar, 12, '0')"
_NEWSAPI = f"""
newsapi as (
  select 'newsapi' as source_kind, 0 as rank, *, {_HASHED} from (
    select doc_id, {_PID} as payload_id, 0 as pos, 'newsapi:' || source as source,
           trim(headline, chr(32) || chr(9) || chr(10) || chr(13)) as headline, url, published_at,
           body, 'desk' as author from articles
    union all
    select doc_id, {_PID} as payload_id, 3 as pos, 'newsapi:unknown' as source,
           'Update: ' || body as headline, url,
           case when doc_id % 7 <> 0 then published_at end as published_at, body, '' as author
    from articles))
"""
_AV = f"""
av as (
  select 'alpha_vantage' as source_kind, 2 as rank, *, {_HASHED} from (
    select doc_id, {_PID} as payload_id, 0 as pos, 'av:' || source as source,
           trim(headline, chr(32) || chr(9) || chr(10) || chr(13)) as headline, url, published_at,
           body, case when doc_id % 2 = 0 then 'first' else '' end as author from articles))
"""
_RSS = f"""
rss as (
  select 'rss' as source_kind, 1 as rank, * exclude (feed, last_at), {_HASHED} from (
    select doc_id, lpad((doc_id // 25)::varchar, 12, '0') as payload_id, doc_id // 25 as feed,
           cast(doc_id % 25 as int) as pos,
           'rss:' || case when (doc_id // 25) % 2 = 0 then 'Feed ' || (doc_id // 25)
                     else 'http://feeds/' || lpad((doc_id // 25)::varchar, 12, '0') end as source,
           trim(headline, chr(32) || chr(9) || chr(10) || chr(13)) as headline, url,
           max(published_at) over (partition by doc_id // 25) as last_at,
           case when doc_id % 3 = 0 then published_at
                else max(published_at) over (partition by doc_id // 25) end as published_at,
           body, '' as author
    from articles))
"""
_RSS_CAPPED = _RSS.replace("    from articles))", "    from articles) where pos < 20)")
_ROW = (
    f"payload_id, pos, source, headline, url, {_iso('published_at')} as published_at, body, "
    "author, content_hash"
)
_REASON = """
case when doc_id % 11 = 0 then 'not a JSON record' when doc_id % 13 = 0 then 'missing url'
     when doc_id % 17 = 0 then 'bad published_at' end
"""

# --- toy models ----------------------------------------------------------------------------------------


def _count(terms) -> str:
    return "(" + " + ".join(
        f"(length(headline) - length(replace(headline, '{t}', ''))) // {len(t)}" for t in terms
    ) + ")"


_UP = _count(("rise", "beats", "record", "surge", "growth"))
_DOWN = _count(("crash", "miss", "fades", "cut", "flat"))


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["content_hash"] = _art("select doc_id, content_hash from articles")
    q["full_text"] = _art("select doc_id, full_text from articles")
    q["hedge_score"] = _feat(f"select doc_id, {_rs('hedge_score')} from features")
    q["negation"] = _feat("select doc_id, has_negation from features")
    q["forward_looking"] = _feat("select doc_id, is_forward_looking from features")
    q["tickers"] = _feat(f"select doc_id, {_TK} from features")
    q["sectors"] = _feat(f"select doc_id, {_SE} from features")
    q["sector_counts"] = _feat(
        f"select {_SECTOR_MAP}[t] as sector, count(*) as mentions "
        "from (select unnest(tickers) as t from features) where sector is not null group by 1"
    )
    q["market_impact"] = _feat("select doc_id, market_impact from features")
    q["features"] = _feat(
        f"select doc_id, {_TK}, {_SE}, is_forward_looking, has_negation, {_rs('hedge_score')}, "
        "market_impact from features"
    )
    q["score_udf"] = _art(
        "select content_hash as article_hash, m as model_ix, "
        f"{_r('(up + m + 1) / (up + down + 2 * m + 3)')} as positive_prob, "
        f"{_r('(down + m + 1) / (up + down + 2 * m + 3)')} as negative_prob, "
        f"{_r('1 / (up + down + 2 * m + 3)')} as neutral_prob "
        f"from (select content_hash, {_UP} as up, {_DOWN} as down from articles), "
        "(select unnest(range(3))::int as m)"
    )
    q["entities"] = _art(
        f"""select doc_id, found[i] as text, 'ORG' as entity_type, {_r('0.6e0 + 0.1e0 * length(found[i])')} as confidence,
                   pos0::int as start_char, (pos0 + length(found[i]))::int as end_char
            from (select doc_id, found, i, list_sum(list_transform(parts[1:i], lambda x: length(x)))
                         + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as pos0
                  from (select doc_id, regexp_extract_all(headline, '[A-Z]{{2,5}}') as found,
                               regexp_split_to_array(headline, '[A-Z]{{2,5}}') as parts,
                               unnest(range(1, len(regexp_extract_all(headline, '[A-Z]{{2,5}}')) + 1)) as i
                        from articles))
            where length(found[i]) > 2"""
    )
    q["impact_fallback"] = _art(
        f"select doc_id, coalesce({_KEYWORD}, case when contains(headline, 'names new') then 'high' "
        "else 'low' end) as market_impact from articles"
    )
    q["entities_batched"] = q["entities"]
    q["impact_fallback_batched"] = q["impact_fallback"]
    leading = r"(select content_hash, regexp_extract(headline, '^\s*(?:\S+\s+){0,511}\S*') as headline from articles)"
    q["score_leading"] = q["score_udf"].replace("as down from articles)", f"as down from {leading})")
    probs = "positive_prob, negative_prob, neutral_prob"
    three = _rs("positive_prob", "negative_prob", "neutral_prob")
    q["model_argmax"] = _sco(
        f"select article_hash, model_ix::int as model_ix, {_name(_argmax(*probs.split(', ')))} as sentiment from scores"
    )
    q["ensemble"] = _sco(
        f"select article_hash, {_r(f'sum({_W} * positive_prob)')} as positive_prob, "
        f"{_r(f'sum({_W} * negative_prob)')} as negative_prob, "
        f"{_r(f'sum({_W} * neutral_prob)')} as neutral_prob from scores group by 1"
    )
    q["temperature_scaled"] = _sco(
        f"""select article_hash, {three}, {_r('greatest(positive_prob, negative_prob, neutral_prob)')}
              as ensemble_confidence, {_name(_argmax(*probs.split(', ')))} as ensemble_sentiment
            from (select article_hash, e0 / (e0 + e1 + e2) as positive_prob,
                         e1 / (e0 + e1 + e2) as negative_prob, e2 / (e0 + e1 + e2) as neutral_prob
                  from (select article_hash, exp(ln(sum({_W} * positive_prob) + 1e-9) / 1.5) as e0,
                               exp(ln(sum({_W} * negative_prob) + 1e-9) / 1.5) as e1,
                               exp(ln(sum({_W} * neutral_prob) + 1e-9) / 1.5) as e2
                        from scores group by 1))"""
    )
    predicted = (_ARTICLES, _SCORES, _PASSES, _PREDICTED)
    q["mc_uncertainty"] = _with(
        f"select article_hash, {_rs('ensemble_uncertainty')} from mc", *predicted
    )
    q["predictions"] = _with(
        f"select article_hash, {three}, {_rs('ensemble_confidence', 'ensemble_uncertainty')}, "
        "ensemble_sentiment, is_uncertain, "
        f"array_to_string(list_transform(preds, lambda x: {_NAMES}[x + 1]), ',') as model_sentiments, "
        "3 as model_count from predicted", *predicted,
    )
    q["analyse"] = _with(
        f"select headline as text, ensemble_sentiment as sentiment, {_r('ensemble_confidence')} as confidence, "
        f"{_r('ensemble_uncertainty')} as uncertainty, {three}, is_uncertain, 3 as model_count, "
        "1.0::double as temperature from articles join predicted on content_hash = article_hash",
        *predicted,
    )
    q["enrich"] = _res(
        f"select article_hash, headline, url, source, {_iso('published_at')} as published_at, "
        f"{_iso('processed_at')} as processed_at, ensemble_sentiment, "
        f"{_rs('ensemble_confidence', 'ensemble_uncertainty')}, {three}, {_rs('hedge_score')}, "
        f"3 as model_count, 0 as entity_count, {_TK}, {_SE}, is_forward_looking, has_negation, "
        "market_impact, is_uncertain, true as temperature_scaled from results"
    )
    q["insert_if_absent"] = _res(
        "select article_hash, 1::bigint as copies, "
        "case when source < 'src2' then 'first' else market_impact end as market_impact from results"
    )
    # serving
    q["recent"] = _res(
        f"select {_BRIEF} from (select results.* from results, now where published_at >= as_of - interval 1 hour {_NEWEST} 500)"
    )
    q["insert_indexed"] = _res(
        f"select article_hash, ensemble_sentiment, {_iso('published_at')} as published_at from results")
    q["by_ticker"] = _res(f"select {_BRIEF} from {_ticker_rows('AAPL', 24)}")
    q["by_ticker_postings"] = q["by_ticker"]
    q["dashboard_filter"] = _res(
        f"select {_BRIEF} from results, now where published_at >= as_of - interval 6 hour "
        "and ensemble_confidence >= 0.45 and ensemble_sentiment in ('positive', 'negative') "
        "and market_impact in ('high', 'medium') and not is_uncertain"
    )
    q["uncertain_flag"] = _with(
        "select article_hash, ensemble_uncertainty > 0.98 as is_uncertain from predicted", *predicted
    )
    for name, n in (("latest_n", 100), ("live_feed", 200), ("load_results", 500)):
        q[name] = _res(f"select {_BRIEF} from results {_NEWEST} {n}".replace("from results", "from (select * from results") + ")")
    q["latest_or_recent"] = _res(
        f"select {_BRIEF}, 'filled' as asked from (select * from results {_NEWEST} 50) union all "
        f"select {_BRIEF}, 'empty' as asked from (select results.* from results, now "
        f"where published_at >= as_of - interval 24 hour {_NEWEST} 40)"
    )
    q["scatter_sample"] = _res(
        f"select article_hash, {_rs('ensemble_confidence', 'ensemble_uncertainty')}, ensemble_sentiment, "
        "headline, source from (select * from results order by md5(article_hash), article_hash limit 300)"
    )
    q["article_table"] = _res(
        f"select {_iso('published_at')} as published_at, headline, source, ensemble_sentiment, "
        f"{_rs('ensemble_confidence', 'ensemble_uncertainty')}, market_impact, {_TK}, is_uncertain "
        f"from (select * from results {_NEWEST} 100)"
    )
    wire_time = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ') as {0}"
    q["article_wire"] = _art(
        f"select source, headline, url, {wire_time.format('published_at')}, body, author, content_hash from articles"
    )
    q["result_wire"] = _res(
        f"select article_hash, headline, url, source, {wire_time.format('published_at')}, "
        f"{wire_time.format('processed_at')}, ensemble_sentiment, "
        + ", ".join(f"{_r(c, 4)} as {c}" for c in ("ensemble_confidence", "ensemble_uncertainty",
                    "positive_prob", "negative_prob", "neutral_prob", "hedge_score"))
        + f", {_TK}, {_SE}, is_forward_looking, has_negation, market_impact, is_uncertain, 3 as model_count from results"
    )
    as_json = "'[' || array_to_string(list_transform({0}, lambda t: '\"' || t || '\"'), ',') || ']' as {0}"
    q["text_store"] = _res(
        f"select article_hash, {as_json.format('tickers')}, {as_json.format('sectors')}, "
        "is_forward_looking::int as is_forward_looking, has_negation::int as has_negation, "
        f"is_uncertain::int as is_uncertain, {wire_time.format('published_at')}, "
        "len(tickers)::int as ticker_count, is_uncertain as uncertain_again, "
        f"{_iso('published_at')} as published_again from results"
    )
    # rollups
    q["hourly_rollup"] = _res(_HOURLY_OUT, _HOURLY)
    q["hourly_partials"] = q["hourly_rollup"]
    q["stream_hourly"] = q["hourly_rollup"]
    q["query_hourly"] = _res(_HOURLY_OUT + ", now where bucket >= as_of - interval 3 hour".replace("bucket", "rollup.bucket"), _HOURLY)
    q["hourly_by_sentiment"] = _res(
        f"select {_iso('bucket')} as bucket, ensemble_sentiment, sum(article_count)::bigint as article_count "
        "from rollup group by rollup.bucket, ensemble_sentiment", _HOURLY,
    )
    q["ticker_summary"] = _res(
        f"select 'NVDA' as ticker, 48 as hours, count(*) as article_count, {_shares()}, 'db' as source "
        f"from {_ticker_rows('NVDA', 48)} having count(*) > 0"
    )
    exploded = "(select unnest(tickers) as ticker, * exclude (tickers) from results)"
    q["ticker_aggregates"] = _res(
        f"select ticker, count(*) as article_count, {_shares()}, "
        f"{_r('avg(ensemble_uncertainty)', 4)} as avg_uncertainty from {exploded} group by ticker"
    )
    q["ticker_cache_or_table"] = _res(
        f"select ticker, count(*) as article_count, {_shares()}, "
        f"{_r('avg(ensemble_uncertainty)', 4)} as avg_uncertainty, 'cache' as source, null::int as hours "
        f"from {exploded} where ticker = 'AAPL' and market_impact = 'medium' group by ticker union all "
        f"select 'GS' as ticker, count(*) as article_count, {_shares()}, null::double as avg_uncertainty, "
        f"'db' as source, 24 as hours from {_ticker_rows('GS', 24)} having count(*) > 0"
    )
    q["ticker_summary_whole"] = _whole(q["ticker_summary"], "NVDA", 48)
    q["ticker_summary_postings"] = q["ticker_summary_whole"]
    q["ticker_cache_or_table_whole"] = _whole(q["ticker_cache_or_table"], "GS", 24)
    q["kpis"] = _res(
        "select articles, " + _rs("positive_pct", "negative_pct", "avg_confidence_pct", "avg_uncertainty_pct")
        + f", {_r('positive_pct - 50')} as positive_vs_half_pp from (select count(*) as articles, "
        "coalesce(avg((ensemble_sentiment = 'positive')::int), 0) * 100 as positive_pct, "
        "coalesce(avg((ensemble_sentiment = 'negative')::int), 0) * 100 as negative_pct, "
        "coalesce(avg(ensemble_confidence), 0) * 100 as avg_confidence_pct, "
        "coalesce(avg(ensemble_uncertainty), 0) * 100 as avg_uncertainty_pct from results)"
    )
    q["sentiment_mix"] = _res(
        f"select ensemble_sentiment, count(*) as article_count, {_r('count(*) / sum(count(*)) over ()')} as share "
        "from results group by 1"
    )
    q["ticker_heatmap"] = _res(
        "select ticker, " + ", ".join(
            f"count(*) filter (ensemble_sentiment = '{s}') as {s}" for s in vocab.SENTIMENTS)
        + f", count(*) as total from {exploded} group by ticker order by total desc, ticker limit 20"
    )
    q["confidence_distribution"] = _res(
        f"""select s.ensemble_sentiment, count(*) as article_count,
              count(*) filter (ensemble_confidence < lower_fence or ensemble_confidence > upper_fence) as outliers,
              """ + ", ".join(f"{_r(f'any_value({c})')} as {c}" for c in
                              ("lowest", "q1", "median", "q3", "highest", "lower_fence", "upper_fence")) + """
            from results r join (
              select ensemble_sentiment, lowest, q1, median, q3, highest, q1 - 1.5e0 * (q3 - q1) as lower_fence,
                     q3 + 1.5e0 * (q3 - q1) as upper_fence
              from (select ensemble_sentiment, min(ensemble_confidence) as lowest,
                           quantile_cont(ensemble_confidence, 0.25) as q1,
                           quantile_cont(ensemble_confidence, 0.5) as median,
                           quantile_cont(ensemble_confidence, 0.75) as q3,
                           max(ensemble_confidence) as highest from results group by 1)) s
            using (ensemble_sentiment) group by 1"""
    )
    q["confidence_sketched"] = q["confidence_distribution"]
    q["run_summary"] = _res(
        f"select {_r('avg(ensemble_confidence)')} as avg_confidence, {_r('avg(ensemble_uncertainty)')} as avg_uncertainty, "
        "count(*) filter (is_uncertain) as uncertain_count, count(*) as total from results"
    )
    q["label_counts"] = _res(" union all ".join(
        f"select {k} as class_ix, '{s}' as label, count(*) filter (ensemble_sentiment = '{s}') as label_count, "
        f"{_r(f'''count(*) filter (ensemble_sentiment = '{s}') / count(*)''')} as share from results"
        for k, s in enumerate(vocab.SENTIMENTS)
    ))
    q["latency_histogram"] = _histogram(E2E_BUCKETS)
    q["produce_histogram"] = _histogram(PRODUCE_BUCKETS)
    span = "(epoch_us(max(processed_at)) - epoch_us(min(published_at))) / 1e6"
    q["throughput"] = _res(
        f"select {_iso('date_trunc(' + chr(39) + 'hour' + chr(39) + ', published_at)')} as batch, count(*) as rows, "
        f"{_r(span)} as elapsed_s, {_r(f'count(*) / ({span})')} as rows_per_s from results group by 1"
    )
    q["rate_limit_sliding"] = (
        "select user_id as client, event_id as call, n as calls_in_window, n > 2 as limited from ("
        "select user_id, event_id, count(*) over (partition by user_id order by ts "
        "range between interval 3600 second preceding and current row) as n from events)"
    )
    q["rate_limit_idle"] = """
      with gaps as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 3600 second as cut from events),
      runs as (select *, sum(coalesce(cut, true)::int) over (partition by user_id order by ts, event_id) as run from gaps)
      select user_id as client, event_id as call, n as calls_since_idle, n > 2 as limited
      from (select *, row_number() over (partition by user_id, run order by ts, event_id) as n from runs)"""
    # de-duplication
    q["dedup_exact"] = _with("select min(ordinal) as ordinal, content_hash from raw_docs group by 2", _RAW)
    q["simhash"] = _with(f"select ordinal, {_FP.format('fp')} as fingerprint from prints", _RAW, _PRINTS)
    q["near_pairs"] = _with(
        f"""select least({_FP.format('a.fp')}, {_FP.format('b.fp')}) as fp_low,
                   greatest({_FP.format('a.fp')}, {_FP.format('b.fp')}) as fp_high,
                   bit_count(xor(a.fp, b.fp))::int as distance
            from (select distinct fp from prints) a join (select distinct fp from prints) b
              on a.fp < b.fp and bit_count(xor(a.fp, b.fp)) < 4""", _RAW, _PRINTS,
    )
    q["dedup_near"] = _with(
        "select ordinal, content_hash from walk join ordered using (rn) where keep", _RAW, _PRINTS, _KEPT
    ).replace("with ", "with recursive ", 1)
    q["stream_near_dedup"] = _with(
        "select ordinal, content_hash from walk join ordered using (rn) where keep",
        _RAW, _PRINTS, _ARRIVED, _KEPT_IN_WINDOW,
    ).replace("with ", "with recursive ", 1)
    q["stream_dedup"] = _with(
        "select ordinal, content_hash from firsts", _RAW, _ARRIVED, _FIRST_IN_WINDOW
    ).replace("with ", "with recursive ", 1)
    q["drop_seen"] = _with(
        "select ordinal from raw_docs where source <> 'src0' and content_hash not in "
        "(select content_hash from raw_docs where source = 'src0')", _RAW,
    )
    for name, rss, cap in (("fetch_all", _RSS, ""), ("fetch_all_capped", _RSS_CAPPED, "limit 100")):
        q[name] = _with(
            f"""select source, headline, url, {_iso('published_at')} as published_at, body, author, content_hash
                from (select d.* from walk join ordered using (rn) join raw_docs d using (ordinal) where keep
                      order by d.published_at desc nulls last, ordinal {cap})""",
            _ARTICLES, _NEWSAPI, rss, _AV, _FETCHED, _PRINTS, _KEPT,
        ).replace("with ", "with recursive ", 1)
    # evaluation
    q["calibrate_temperature"] = _eva("select round_even(exp(log_t), 3) as temperature, "
                                      "round_even(nll, 6) as nll from pass5", *_calibration())
    q["confusion"] = _eva(" union all ".join(
        f"select {t} as y_true, {p} as y_pred, c{t}{p} as n, {_r(f'c{t}{p} / greatest({_sup(t)}, 1)', 4)} as row_share from cells"
        for t in _K for p in _K), _CELLS)
    q["class_metrics"] = _eva(
        f"select class_name, {_r(chr(34) + 'precision' + chr(34))} as \"precision\", {_rs('recall', 'f1', 'share')}, support from classes",
        _CELLS, _CLASSES)
    q["f1_summary"] = _eva(
        f"select n_samples, {_rs('accuracy', 'macro_f1', 'micro_f1', 'weighted_f1')} from summary", _CELLS, _SUMMARY)
    q["mcc_kappa"] = _eva(f"select {_rs('mcc', 'cohen_kappa')} from summary", _CELLS, _SUMMARY)
    q["rank_metrics"] = _eva(f"select class_name, {_rs('roc_auc', 'pr_auc')} from ranks", _RANKS)
    q["ece_bins"] = _eva(f"select bin::int as bin, n, {_rs('accuracy', 'mean_confidence')} from bins", _ECE)
    q["ece"] = _eva(f"select {_rs('ece')} from ece_row", _ECE)
    q["brier_and_rates"] = _eva(
        f"select {_rs('brier_score', 'ensemble_disagreement', 'uncertain_fraction')} from rates", _rates(0.98))
    q["reliability"] = _eva(
        f"select ({_bin('p0', 10, '>')})::int as bin, count(*) as n, {_r('avg(p0)')} as mean_predicted_prob, "
        f"{_r('avg((y_true = 0)::int)')} as fraction_positive from eval_rows group by 1")
    q["latency_percentiles"] = _eva("select * from latency", _LATENCY)
    q["latency_sketched"] = q["latency_percentiles"]
    q["eval_metrics"] = _eva(f"select metric, {_rs('value')} from flat", *_REPORT)
    q["eval_report"] = _eva(
        "select " + ", ".join(_pick(c, c) for c in _WIDE)
        + ", max(value) filter (metric = 'eval/n_samples')::bigint as n_samples, "
        + ", ".join(_pick(f"{s}/{c}", f"{s}_{c}") for s in vocab.SENTIMENTS
                    for c in ("precision", "recall", "f1", "pr_auc", "roc_auc", "support"))
        + " from flat", *_REPORT)
    flip, klass = (_h("article_hash", "'42'", f"'{t}'") for t in ("flip", "class"))
    q["noisy_truth"] = _eva(
        f"select article_hash, (case when {flip} % 100 < 15 then {klass} % 3 else y_true end)::int as y_true from eval_rows")
    q["label_lookup"] = _res(
        "select doc_id, y_pred, coalesce(case quality when 1 then 0 when 0 then 1 end, y_pred)::int as y_true "
        "from results left join labels using (doc_id)")
    # drift
    q["psi"] = _res(f"select {_rs('psi')}, psi_band as band from measured, report", *_BY_IMPACT)
    q["chi2"] = _res("select chi2_pvalue from report", *_BY_IMPACT)
    q["js"] = _res("select js_divergence from report", *_BY_IMPACT)
    q["drift_report"] = _res("select * from report", *_BY_SURE)
    q["drift_metrics"] = _res(" union all ".join(
        f"select 'drift/{m}' as metric, {c} as value, case when is_drifting then alerts end as drift_alert from report"
        for m, c in (("psi", "psi_confidence"), ("js", "js_divergence"), ("chi2_pvalue", "chi2_pvalue"))), *_BY_SURE)
    thick = "select * from report where reference_rows >= 50 and current_rows >= 10"
    q["drift_check"] = _res(thick, *_CHECK)
    q["drift_check_profiled"] = q["drift_check"]
    q["drift_hourly"] = _res(
        "select * replace (strftime(checked_at, '%Y-%m-%dT%H:%M:%S') as checked_at) "
        "from report where reference_rows >= 50 and current_rows >= 10", *_HOURS,
    )
    q["drift_check_capped"] = _res(thick, *_CHECK_CAPPED)
    q["drift_split_half"] = _res("select * from report", _HALVED, *_HALVES)
    # sources
    q["normalize_newsapi"] = _with(f"select {_ROW} from newsapi", _ARTICLES, _NEWSAPI)
    q["normalize_rss"] = _with(f"select {_ROW} from rss", _ARTICLES, _RSS)
    q["normalize_rss_capped"] = _with(f"select {_ROW} from rss where pos < 20", _ARTICLES, _RSS)
    q["normalize_av"] = _with(
        f"select {_ROW} from av", _ARTICLES, _AV)
    q["fetch_stats"] = _with(
        f"""select source_kind, count(*) as fetched, count(*) filter (copy > 1) as deduplicated,
                   case when source_kind = 'newsapi' then (select count(*) from documents) else 0 end as errors,
                   {_r('count(*) filter (copy = 1) / count(*)')} as yield_rate
            from (select source_kind, row_number() over (partition by content_hash order by rank, payload_id, pos) as copy
                  from (select source_kind, rank, payload_id, pos, content_hash from newsapi union all
                        select source_kind, rank, payload_id, pos, content_hash from rss union all
                        select source_kind, rank, payload_id, pos, content_hash from av))
            group by 1""", _ARTICLES, _NEWSAPI, _RSS, _AV)
    q["to_topic"] = _art(
        f"select content_hash as key, source, headline, url, {wire_time.format('published_at')}, body, author from articles")
    q["decode_messages"] = _art(
        f"select source, headline, url, {_iso('published_at')} as published_at, body, author, content_hash "
        f"from articles where {_REASON} is null")
    q["dead_letters"] = _art(f"select doc_id as id, {_REASON} as _dlq_reason from articles where _dlq_reason is not null")
    q["decode_status"] = _art(
        f"select case when doc_id % 19 = 0 then 'error' when {_REASON} is not null then 'deserialise_error' "
        "else 'ok' end as status, count(*) as messages from articles group by 1")
    # streams
    q["stream_enrich"] = _res(
        f"select article_hash, ensemble_sentiment, market_impact, is_uncertain, {_TK}, "
        f"{_rs('ensemble_confidence', 'ensemble_uncertainty', 'hedge_score')} from results where {_REASON} is null")
    q["stream_dead_letters"] = _art(
        f"select {_REASON} as _dlq_reason, count(*) as messages from articles where _dlq_reason is not null group by 1")
    q["stream_ticker_state"] = _res(
        "select ticker, count(*) as article_count, " + ", ".join(
            f"count(*) filter (ensemble_sentiment = '{s}') as {s}_count" for s in vocab.SENTIMENTS)
        + f" from {exploded} group by ticker")
    # Rows of a ticker since its last silence of more than 200 seconds, if that is not over.
    q["stream_ticker_ttl"] = _res(
        f"select ticker, count(*) as article_count, " + ", ".join(
            f"count(*) filter (ensemble_sentiment = '{s}') as {s}_count" for s in vocab.SENTIMENTS)
        + f", {_iso('max(published_at)')} as updated_at from ("
        "select *, sum(cut) over (partition by ticker order by published_at) as run, "
        "sum(cut) over (partition by ticker) as runs from ("
        "select *, (published_at - lag(published_at) over (partition by ticker order by published_at) > interval 200 second)::int as cut "
        f"from {exploded})) where coalesce(run, 0) = coalesce(runs, 0) group by ticker "
        "having max(published_at) >= (select as_of from now) - interval 200 second")
    q["stream_latest"] = _res(
        f"select article_hash, {_iso('published_at')} as published_at from (select * from results {_NEWEST} 1000)")
    q["stream_publish"] = _res(
        "select article_hash, ensemble_sentiment, market_impact, '3' as model_count from results")
    return q
