"""Base score and the five strategy scores as one column program."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from norrsken import constants as K
from norrsken.functions.numeric import compact_number, round_dp
from norrsken.functions.rules import Rule, fired_texts, total_points
from norrsken.functions.text import distinct_texts, has_signal, may_repeat, searchable, text_keys
from norrsken.operators import signals
from norrsken.operators.quality import with_gate, with_quality
from norrsken.schemas import SCORE_COLUMNS

# --- fixed values: points -----------------------------------------------------------------
CATALYST_CAP = 24.0
STATED_RISK_POINTS, STATED_RISK_CAP = 3.0, 15.0
DATA_QUALITY_POINTS = {"good": 0.0, "partial": 7.0, "thin": 14.0}
TRADING_VALUE_WEIGHT, TRADING_DISCOVERY_WEIGHT = 0.15, 0.25
LONG_TERM_DISCOVERY_WEIGHT = 0.35


def normalise_strategies(strategies: str | Sequence[str]) -> tuple[str, ...]:
    names = [strategies] if isinstance(strategies, str) else list(strategies)
    clean = tuple(name.strip().lower() for name in names)
    unknown = [name for name in clean if name not in K.STRATEGIES]
    if unknown or not clean:
        raise ValueError("strategy must be one of: " + ", ".join(K.STRATEGIES))
    return clean


def _value_rules() -> list[Rule]:
    pe = F.col("pe_ratio")
    low_pe = F.concat(F.lit("low P/E ("), compact_number(pe), F.lit(")"))
    return [
        Rule(pe <= 12, 20.0, low_pe),
        Rule(F.col("price_to_book") <= 1.2, 15.0, "low P/B"),
        Rule(F.col("net_cash_eur_m") > 0, 10.0, "net cash balance sheet"),
    ]


def _discovery_rules() -> list[Rule]:
    return [
        Rule(F.col("market_cap_eur_m") <= 500, 15.0, "small market cap"),
        Rule(F.col("segment") == "first_north", 10.0, "First North listing"),
        Rule(F.col("one_year_return_pct") <= -25, 8.0, "one-year underperformance"),
        Rule(F.col("distance_from_52w_high_pct") <= -35, 7.0, "far below 52-week high"),
    ]


def _risk_rules() -> list[Rule]:
    return [
        Rule(F.col("average_daily_value_eur") < 100_000, 8.0, "thin liquidity"),
        Rule(F.col("debt_to_equity") > 1.5, 8.0, "high debt/equity"),
        Rule(F.col("operating_margin_pct") < 0, 10.0, "negative operating margin"),
        Rule(F.col("pe_ratio") > 40, 10.0, "high P/E"),
        Rule(F.col("price_to_book") > 5, 8.0, "high P/B"),
    ]


def catalyst_points(catalyst: Column) -> Column:
    return (
        F.when(catalyst.startswith(K.STRONG_MOMENTUM), 7.0)
        .when(catalyst.startswith(K.POSITIVE_MOMENTUM), 3.0)
        .when(catalyst == K.LIVE_PRICE, 2.0)
        .when(catalyst == K.MODERATE_TURNOVER, 4.0)
        .otherwise(8.0)
    )


def with_base_score(research: DataFrame) -> DataFrame:
    """Adds the base score columns. Null metrics mean unknown and never score."""
    c = F.col
    none = F.array().cast("array<string>")
    quality = F.create_map(*(F.lit(p) for pair in DATA_QUALITY_POINTS.items() for p in pair))
    n_risks = F.size("risks")
    stated = F.when(n_risks > 0, F.concat(n_risks.cast("string"), F.lit(" stated risk(s)")))
    flagged = F.when(
        c("data_quality") != "good", F.concat(c("data_quality"), F.lit(" data quality"))
    )
    value, discovery, risk = _value_rules(), _discovery_rules(), _risk_rules()
    points = F.aggregate("catalysts", F.lit(0.0), lambda total, x: total + catalyst_points(x))
    df = research.withColumns(
        {
            "value": total_points(value),
            "discovery": total_points(discovery),
            "catalyst": F.least(points, F.lit(CATALYST_CAP)),
            "risk_penalty": total_points(risk)
            + F.least(n_risks * STATED_RISK_POINTS, F.lit(STATED_RISK_CAP)),
            "data_quality_penalty": F.try_element_at(quality, c("data_quality")),
        }
    )
    shown = F.when(c("catalyst") != 0, F.slice("catalysts", 1, 3)).otherwise(none)
    extra = [Rule(stated.isNotNull(), text=stated), Rule(flagged.isNotNull(), text=flagged)]
    return df.withColumns(
        {
            "total": c("value") + c("discovery") + c("catalyst")
            - c("risk_penalty") - c("data_quality_penalty"),
            "reasons": F.concat(fired_texts(value + discovery), shown),
            "warnings": fired_texts(risk + extra),
        }
    )


def _signal_flags() -> dict[str, Column]:
    """What the strategies ask of the signal texts, each searched once per company."""
    catalysts, risks = searchable(F.col("catalysts")), searchable(F.col("risks"))

    def anywhere(needle: str) -> Column:
        return has_signal(catalysts, needle) | has_signal(risks, needle)

    return {
        "flag_spike": anywhere(K.EXTREME_SPIKE),
        "flag_risk_spike": has_signal(risks, K.EXTREME_SPIKE),
        "flag_missing_turnover": anywhere(K.MISSING_TURNOVER),
        "flag_low_turnover": anywhere(K.LOW_TURNOVER),
        "flag_low_price": anywhere(K.LOW_PRICE),
        "flag_high_turnover": has_signal(catalysts, K.HIGH_TURNOVER),
        "flag_moderate_turnover": has_signal(catalysts, K.MODERATE_TURNOVER),
        "flag_strong": has_signal(catalysts, K.STRONG_MOMENTUM),
        "flag_intraday": anywhere("intraday momentum"),
        "flag_anchor": fundamental_anchor(),
        "flag_trading_reasons": F.filter("reasons", signals.is_trading_relevant),
        "flag_lasting_reasons": F.filter("reasons", lambda x: ~signals.is_trading_only(x)),
        "flag_lasting_catalysts": F.size(
            F.filter("catalysts", lambda x: ~signals.is_trading_only(x))
        ),
    }


def _adjustments(strategy: str) -> tuple[Column, Column]:
    """Points added to catalyst and to risk."""
    c = F.col
    down = [
        Rule(c("flag_spike"), 18.0), Rule(c("flag_missing_turnover"), 12.0),
        Rule(c("flag_low_turnover"), 10.0), Rule(c("flag_low_price"), 8.0),
    ]
    up: list[Rule] = []
    if strategy == "trading":
        up = [
            Rule(c("flag_high_turnover"), 6.0), Rule(c("flag_moderate_turnover"), 3.0),
            Rule(c("flag_strong"), 5.0),
        ]
        down.append(Rule(c("flag_spike"), 8.0))
    elif strategy == "discovery":
        up = [Rule(c("segment") == "first_north", 4.0)]
        down.append(Rule(c("flag_spike") | c("flag_missing_turnover"), 10.0))
    return (total_points(up) if up else F.lit(0.0)), total_points(down)


def _note(test: Column, note: str) -> Column:
    """The note as an array to append, empty where the test does not hold."""
    return F.when(test, F.array(F.lit(note))).otherwise(F.array().cast("array<string>"))


def _score(strategy: str, **parts: Column) -> Column:
    """The parts of one strategy score. The total follows from them after the explode."""
    return F.struct(
        F.lit(strategy).alias("strategy"),
        *(parts[name].alias(name) for name in SCORE_COLUMNS if name != "total"),
    )


def _total() -> Column:
    c = F.col
    gained = c("score.value") + c("score.discovery") + c("score.catalyst")
    return round_dp(gained - c("score.risk_penalty") - c("score.data_quality_penalty"), 2)


def _adjusted_score(strategy: str) -> Column:
    c = F.col
    value, discovery, reasons = c("value"), c("discovery"), c("reasons")
    if strategy == "trading":
        value = round_dp(value * TRADING_VALUE_WEIGHT, 2)
        discovery = round_dp(discovery * TRADING_DISCOVERY_WEIGHT, 2)
        reasons = c("flag_trading_reasons")
    up, down = (F.lit(0.0), F.lit(0.0)) if strategy == "momentum" else _adjustments(strategy)
    note = f"{strategy} strategy adjustment applied"
    return _score(
        strategy,
        value=value,
        discovery=discovery,
        catalyst=c("catalyst") + up,
        risk_penalty=c("risk_penalty") + down,
        data_quality_penalty=c("data_quality_penalty"),
        reasons=F.concat(reasons, _note(up != 0, note)),
        warnings=F.concat("warnings", _note(down != 0, note)),
    )


def fundamental_anchor() -> Column:
    """Any sign of durable worth that an intraday move can rest on."""
    c = F.col
    tests = (
        c("pe_ratio") <= 18, c("price_to_book") <= 2.0, c("net_cash_eur_m") > 0,
        c("operating_margin_pct") > 0, c("revenue_growth_pct") > 0, c("debt_to_equity") <= 0.5,
    )
    return F.greatest(*(F.coalesce(t, F.lit(False)) for t in tests))


def _long_term_score() -> Column:
    c = F.col
    durable = c("flag_lasting_catalysts")
    intraday, spike = c("flag_intraday"), c("flag_risk_spike")
    unanchored = intraday & ~c("flag_anchor")
    risk = c("risk_penalty") + c("proof_penalty") + total_points(
        [Rule(intraday, 18.0), Rule(spike, 18.0), Rule(unanchored, 12.0)]
    )
    promoted = c("gate.tier").isin(K.TIER_HIGH, K.TIER_WATCHLIST)
    gate_note = F.array(F.concat(F.lit("Gate tier: "), c("gate.tier")))
    none = F.array().cast("array<string>")
    reasons = F.concat(
        c("flag_lasting_reasons"),
        F.when(promoted, gate_note).otherwise(none),
        F.array("bucket"),
        c("quality_reasons"),
    )
    warnings = F.concat(
        c("warnings"),
        c("proof_gaps"),
        _note(intraday | spike, "long-term strategy penalty applied"),
        _note(unanchored, "missing long-term fundamental support"),
        F.when(promoted, none).otherwise(gate_note),
    )
    return _score(
        "long-term",
        value=c("value"),
        discovery=round_dp(c("discovery") * LONG_TERM_DISCOVERY_WEIGHT, 2),
        catalyst=F.least(durable * 8.0, F.lit(16.0)) + c("quality_adjustment"),
        risk_penalty=risk,
        data_quality_penalty=c("data_quality_penalty"),
        reasons=reasons,
        warnings=warnings,
    )


def strategy_scores(research: DataFrame, strategies: str | Sequence[str] = K.STRATEGIES) -> DataFrame:
    """One output row per company and strategy; the base score is computed once per company.

    The strategy scores are built side by side in an array that is then exploded, so no join
    multiplies the input and the scan is read once. Long-term rows keep quality and gate.
    """
    names = normalise_strategies(strategies)
    df = with_base_score(research)
    if "long-term" in names:
        df = with_gate(with_quality(df))
    flags = _signal_flags()
    df = df.withColumns(flags)
    scores = [_long_term_score() if s == "long-term" else _adjusted_score(s) for s in names]
    rest = [name for name in df.columns if name not in SCORE_COLUMNS and name not in flags]
    # The explode also keeps the optimizer from inlining the score expressions into the total and
    # into every later filter, which would grow the plan exponentially. Its argument holds no
    # lambda functions, so it is compiled.
    exploded = df.select(*rest, F.explode(F.array(*scores)).alias("score"))
    parts = [_total().alias("total") if n == "total" else F.col(f"score.{n}") for n in SCORE_COLUMNS]
    flat = exploded.select(*rest, "score.strategy", *parts)
    if "long-term" not in names:
        return flat
    return _with_distinct_texts(flat)


def _with_distinct_texts(scored: DataFrame) -> DataFrame:
    """Long-term texts without repeats. Comparison keys are columns, built once per row.

    Few rows have any. A test in generated code (no two texts alike without case and blanks) keeps all others
    from the lambdas.
    """
    own = F.col("strategy") == "long-term"
    both = ("reasons", "warnings")
    none = F.lit(None).cast("array<string>")
    keyed = scored.withColumns(
        {f"{n}_keys": F.when(own & may_repeat(F.col(n)), text_keys(F.col(n))).otherwise(none) for n in both}
    )
    return keyed.withColumns(
        {
            n: F.when(F.col(f"{n}_keys").isNotNull(), distinct_texts(F.col(n), F.col(f"{n}_keys"))).otherwise(F.col(n))
            for n in both
        }
    ).drop("reasons_keys", "warnings_keys")
