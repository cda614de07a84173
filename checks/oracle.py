"""The registered queries as DuckDB SQL over the test tables.

Written apart from the Spark code: number texts come from printf, quota swaps from
counting, dates from series of days. Shared parts are common table expressions.
"""

from __future__ import annotations


def rd(x: str, digits: int) -> str:
    """Round half even on the exact binary value."""
    s = f"{10 ** digits}e0"
    hi = "(v * 134217729e0 - (v * 134217729e0 - v))"
    gap = f"(v * {s} - round_even(v * {s}, 0))"
    err = f"(({hi} * {s} - v * {s}) + (v - {hi}) * {s})"
    return (
        f"list_transform([cast({x} as double)], lambda v: (round_even(v * {s}, 0) + "
        f"case when abs({gap}) = 0.5 and {err} * {gap} > 0 then {gap} * 2e0 else 0e0 end) / {s})[1]"
    )


def kept(*items: str) -> str:
    """A list of texts without nulls."""
    return f"list_filter([{', '.join(items)}], lambda x: x is not null)"


def when(test: str, text: str) -> str:
    return f"case when {test} then {text} end"


def points(*rules: tuple[str, float]) -> str:
    return "(" + " + ".join(f"case when {t} then {p}e0 else 0e0 end" for t, p in rules) + ")"


def joined(column: str) -> str:
    return f"coalesce(array_to_string({column}, ' | '), '')"


LISTING = """
listing as (
  select 'Holding ' || (c_custkey // 2) || case when c_custkey % 2 = 0 then ' AB (publ)' else ' B Oyj' end as name,
    case when c_custkey % 6 = 2 then 'C ' else 'C' end || c_custkey as ticker,
    case when c_nationkey % 2 = 0 then 'SE' else 'FI' end as country,
    case when c_nationkey % 2 = 0 then 'Nasdaq Stockholm' else 'Nasdaq Helsinki' end as exchange,
    case c_mktsegment when 'BUILDING' then 'first_north' when 'FURNITURE' then 'spotlight'
      when 'HOUSEHOLD' then 'other_public' else 'main_market' end as segment,
    c_mktsegment as sector,
    case when c_custkey % 7 <> 0 then c_acctbal / 10e0 end as market_cap_eur_m,
    case when c_nationkey % 2 = 0 then 'SEK' else 'EUR' end as listing_currency,
    cast(null as varchar) as ir_url,
    case when c_custkey % 4 <> 2 then c_name end as business_description,
    c_custkey as ordinal, c_custkey, c_acctbal
  from customer)"""
QUOTE = """
quote as (
  select o_custkey as c_custkey, o_totalprice / 100000e0 as price,
    (o_totalprice / previous - 1e0) * 10e0 as percentage_change,
    case when o_custkey % 11 <> 0 then o_totalprice * 3e0 end as turnover,
    case when o_custkey % 22 <> 0 then 1e0 end as volume
  from (select *, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous,
          row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
        from orders)
  where rn = 1)"""
FINANCIALS = """
totals as (
  select o_custkey, sum(cast(o_totalprice as decimal(18,4)))::double as order_value,
    (sum(cast(o_totalprice as decimal(18,4))) filter (o_orderdate >= timestamp '1998-06-01'))::double as r1,
    (sum(cast(o_totalprice as decimal(18,4))) filter (o_orderdate < timestamp '1998-06-01'))::double as r0
  from orders group by o_custkey),
financials as (
  select c_custkey,
    case when c_custkey % 4 <> 0 then c_acctbal / 200e0 end as pe_ratio,
    case when c_custkey % 5 <> 0 then (c_acctbal + 1000e0) / 1800e0 end as price_to_book,
    case when c_custkey % 13 <> 0 then (c_custkey % 37 - 5)::double end as ev_to_ebit,
    order_value / 1000000e0 as revenue_eur_m,
    case when c_custkey % 10 <> 0 then (c_acctbal + 900e0) / 25e0 end as book_value_eur_m,
    case when c_custkey % 14 <> 0 then c_acctbal / 150e0 - 5e0 end as net_income_eur_m,
    case when c_custkey % 6 <> 0 then c_acctbal / 500e0 - 5e0 end as net_cash_eur_m,
    case when c_custkey % 9 <> 0 then (c_custkey % 23) / 10e0 end as debt_to_equity,
    (r1 - r0) / r0 * 100e0 as revenue_growth_pct,
    case when c_custkey % 8 <> 0 then (c_custkey % 41 - 12)::double end as operating_margin_pct,
    case when c_custkey % 12 <> 0 then (c_custkey % 120 - 60)::double end as one_year_return_pct,
    case when c_custkey % 16 <> 0 then (-(c_custkey % 80))::double end as distance_from_52w_high_pct,
    order_value / 20e0 as average_daily_value_eur,
    case c_custkey % 3 when 0 then 'good' when 1 then 'partial' else 'thin' end as data_quality
  from customer left join totals on o_custkey = c_custkey)"""

CATALYSTS = kept(
    when("price is not null", "'Live price available from Nasdaq Nordic'"),
    "case when percentage_change >= 10 then 'Strong intraday momentum (+' || printf('%g', percentage_change) || '%)' "
    "when percentage_change >= 5 then 'Positive intraday momentum (+' || printf('%g', percentage_change) || '%)' end",
    "case when turnover >= 1000000 then 'High live turnover' when turnover >= 250000 then 'Moderate live turnover' end",
)
RISKS = kept(
    "'Sparse live-source data'",
    when("percentage_change >= 40", "'Extreme intraday spike'"),
    when("percentage_change <= -5", "'Sharp intraday selloff'"),
    when("price > 0 and price < 1", "'Speculative low-price share'"),
    when("turnover < 100000", "'Low live turnover'"),
    when("q.c_custkey is not null and turnover is null and volume is null", "'Missing live turnover'"),
)
METRICS = (
    "pe_ratio price_to_book ev_to_ebit revenue_eur_m book_value_eur_m net_income_eur_m "
    "net_cash_eur_m debt_to_equity revenue_growth_pct operating_margin_pct one_year_return_pct "
    "distance_from_52w_high_pct average_daily_value_eur"
).split()


def research_cte(name: str = "research", blank_thin: bool = False) -> str:
    metric = [
        f"case when f.data_quality <> 'thin' then f.{m} end as {m}" if blank_thin else f"f.{m}"
        for m in METRICS
    ]
    return f"""
{name} as (
  select l.*, q.price, case when q.price is not null then l.listing_currency end as price_currency,
    q.percentage_change, q.turnover, q.volume, {', '.join(metric)}, f.data_quality,
    {CATALYSTS} as catalysts, {RISKS} as risks
  from listing l left join quote q using (c_custkey) left join financials f using (c_custkey))"""


def base_cte(source: str = "research", name: str = "base") -> str:
    value = points(("pe_ratio <= 12", 20), ("price_to_book <= 1.2e0", 15), ("net_cash_eur_m > 0", 10))
    discovery = points(
        ("market_cap_eur_m <= 500", 15), ("segment = 'first_north'", 10),
        ("one_year_return_pct <= -25", 8), ("distance_from_52w_high_pct <= -35", 7),
    )
    risk = points(
        ("average_daily_value_eur < 100000", 8), ("debt_to_equity > 1.5e0", 8),
        ("operating_margin_pct < 0", 10), ("pe_ratio > 40", 10), ("price_to_book > 5", 8),
    )
    catalyst = (
        "least(coalesce(list_sum(list_transform(catalysts, lambda x: case "
        "when starts_with(x, 'Strong intraday momentum') then 7e0 "
        "when starts_with(x, 'Positive intraday momentum') then 3e0 "
        "when x = 'Live price available from Nasdaq Nordic' then 2e0 "
        "when x = 'Moderate live turnover' then 4e0 else 8e0 end)), 0e0), 24e0)"
    )
    reasons = kept(
        when("pe_ratio <= 12", "'low P/E (' || printf('%g', pe_ratio) || ')'"),
        when("price_to_book <= 1.2e0", "'low P/B'"),
        when("net_cash_eur_m > 0", "'net cash balance sheet'"),
        when("market_cap_eur_m <= 500", "'small market cap'"),
        when("segment = 'first_north'", "'First North listing'"),
        when("one_year_return_pct <= -25", "'one-year underperformance'"),
        when("distance_from_52w_high_pct <= -35", "'far below 52-week high'"),
    )
    warnings = kept(
        when("average_daily_value_eur < 100000", "'thin liquidity'"),
        when("debt_to_equity > 1.5e0", "'high debt/equity'"),
        when("operating_margin_pct < 0", "'negative operating margin'"),
        when("pe_ratio > 40", "'high P/E'"),
        when("price_to_book > 5", "'high P/B'"),
        when("len(risks) > 0", "len(risks) || ' stated risk(s)'"),
        when("data_quality <> 'good'", "data_quality || ' data quality'"),
    )
    return f"""
{name} as (
  select *, value + discovery + catalyst - risk_penalty - data_quality_penalty as total,
    lower(array_to_string(catalysts, '~')) as ct, lower(array_to_string(risks, '~')) as rt
  from (select *, {value} as value, {discovery} as discovery, {catalyst} as catalyst,
      {risk} + least(len(risks) * 3e0, 15e0) as risk_penalty,
      case data_quality when 'good' then 0e0 when 'partial' then 7e0 else 14e0 end as data_quality_penalty,
      list_concat({reasons}, case when {catalyst} <> 0 then catalysts[1:3] else [] end) as reasons,
      {warnings} as warnings
    from {source}))"""


def valuation_cte(source: str, name: str = "valued") -> str:
    cap = "case when market_cap_eur_m > 0 then market_cap_eur_m end"
    sales = rd(f"({cap}) / case when revenue_eur_m > 0 then revenue_eur_m end", 2)
    book = rd(f"({cap}) / case when book_value_eur_m > 0 then book_value_eur_m end", 2)
    cash = rd(f"(case when net_cash_eur_m > 0 then net_cash_eur_m end) / ({cap}) * 100e0", 2)
    income = rd(f"({cap}) / case when net_income_eur_m > 0 then net_income_eur_m end", 2)
    return f"""
proxies_{name} as (
  select *, {sales} as px_sales, {book} as px_book, {cash} as px_cash, {income} as px_income from {source}),
{name} as (
  select *, v.kind is not null as has_support, v.kind as primary_kind, {rd('v.num', 2)} as primary_value,
    coalesce(v.cheap, false) as is_attractive, coalesce(v.words, 'No valuation metric or proxy is available.') as valuation_summary
  from (select *, case
    when pe_ratio > 0 then {{'kind': 'pe_ratio', 'num': pe_ratio, 'cheap': pe_ratio <= 14, 'words': 'P/E is ' || printf('%g', pe_ratio) || '.'}}
    when price_to_book > 0 then {{'kind': 'price_to_book', 'num': price_to_book, 'cheap': price_to_book <= 1.5e0, 'words': 'Price/book is ' || printf('%g', price_to_book) || '.'}}
    when ev_to_ebit > 0 then {{'kind': 'ev_to_ebit', 'num': ev_to_ebit, 'cheap': ev_to_ebit <= 12, 'words': 'EV/EBIT is ' || printf('%g', ev_to_ebit) || '.'}}
    when px_sales is not null then {{'kind': 'market_cap_to_sales', 'num': px_sales, 'cheap': px_sales <= 2, 'words': 'Market cap/sales is ' || printf('%g', px_sales) || 'x.'}}
    when px_book is not null then {{'kind': 'market_cap_to_book', 'num': px_book, 'cheap': px_book <= 1.5e0, 'words': 'Market cap/book value is ' || printf('%g', px_book) || 'x.'}}
    when px_cash is not null then {{'kind': 'net_cash_to_market_cap', 'num': px_cash, 'cheap': px_cash >= 20, 'words': 'Net cash equals ' || printf('%g', px_cash) || '% of market cap.'}}
    when px_income is not null then {{'kind': 'earnings_yield_pe', 'num': px_income, 'cheap': px_income <= 14, 'words': 'Implied P/E is ' || printf('%g', px_income) || '.'}}
    end as v from proxies_{name}))"""


PROFILE = "coalesce(business_description, '') <> ''"
DURABLE = (
    "(coalesce(operating_margin_pct > 0, false) or coalesce(revenue_growth_pct > 0, false) or "
    "coalesce(net_cash_eur_m > 0, false) or coalesce(debt_to_equity <= 0.5e0, false) or "
    f"is_attractive or {PROFILE})"
)
LIVE_ONLY = (
    "(contains(lower(array_to_string(catalysts, '~')), 'live price available') or "
    "contains(lower(array_to_string(catalysts, '~')), 'live turnover') or "
    "contains(lower(array_to_string(catalysts, '~')), 'intraday momentum'))"
)
SEVERE = (
    "['No profitability signal', 'Negative operating margin', 'High debt/equity', "
    "'Thin data quality', 'Missing business description', 'Missing liquidity data']"
)


def quality_ctes(source: str) -> str:
    """valued, quality and gated on top of a research-like source."""
    adj = [
        ("segment = 'first_north'", 5, "First North discovery opportunity"),
        ("operating_margin_pct > 0", 10, "Positive operating margin"),
        ("revenue_growth_pct > 0", 8, "Revenue growth"),
        ("net_cash_eur_m > 0", 7, "Net cash balance sheet"),
        ("debt_to_equity <= 0.5e0", 5, "Conservative balance sheet"),
        ("is_attractive", 8, "Attractive valuation support"),
        ("has_support and not is_attractive", 2, "Valuation data available"),
        (PROFILE, 4, "Business description available"),
        ("average_daily_value_eur >= 100000", 3, "Adequate liquidity"),
    ]
    pen = [
        ("operating_margin_pct < 0", 14, "Negative operating margin"),
        ("operating_margin_pct is null or operating_margin_pct = 0", 8, "No profitability signal"),
        ("revenue_growth_pct is null or revenue_growth_pct <= 0", 7, "No growth signal"),
        ("debt_to_equity > 1.5e0", 10, "High debt/equity"),
        ("not has_support", 9, "Missing valuation data"),
        (f"not ({PROFILE})", 5, "Missing business description"),
        ("average_daily_value_eur < 100000", 7, "Thin liquidity"),
        ("average_daily_value_eur is null", 6, "Missing liquidity data"),
        (f"{LIVE_ONLY} and not {DURABLE}", 12, "Only live-market support"),
        ("data_quality = 'thin'", 8, "Thin data quality"),
    ]
    anchors = kept(
        when("operating_margin_pct > 0", "'positive operating margin'"),
        when("revenue_growth_pct > 0", "'revenue growth'"),
        when("net_cash_eur_m > 0", "'net cash balance sheet'"),
        when("debt_to_equity <= 0.5e0", "'conservative balance sheet'"),
        when("average_daily_value_eur >= 100000", "'adequate liquidity'"),
        "case when is_attractive then 'attractive valuation support' when has_support then 'valuation data available' end",
    )
    return valuation_cte(source) + f""",
quality as (
  select *, case when proof_penalty >= 35 or len(proof_gaps) >= 5 then 'Insufficient evidence'
      when quality_adjustment >= 32 and proof_penalty <= 8 then 'Quality small-cap candidate'
      when quality_adjustment >= 20 and proof_penalty <= 18 then 'Fundamental watchlist candidate'
      else 'Speculative small-cap monitor' end as bucket
  from (select *, gap_points + case when data_quality = 'partial' and len(proof_gaps) > 0 then 3e0 else 0e0 end as proof_penalty
    from (select *, {points(*((t, p) for t, p, _ in adj))} as quality_adjustment,
        {kept(*(when(t, f"'{x}'") for t, _, x in adj))} as quality_reasons,
        {points(*((t, p) for t, p, _ in pen))} as gap_points,
        {kept(*(when(t, f"'{x}'") for t, _, x in pen))} as proof_gaps
      from valued))),
gated as (
  select *, case tier0 when 'High-conviction candidate' then
      case when len(severe) > 0 or len(anchors) < 2 or not has_support then 'Fundamental watchlist' else tier0 end
      else tier0 end as tier
  from (select *, case when bucket = 'Quality small-cap candidate' then 'High-conviction candidate'
        when bucket = 'Fundamental watchlist candidate' and len(anchors) >= 3 then 'High-conviction candidate'
        when bucket = 'Fundamental watchlist candidate' then 'Fundamental watchlist'
        when bucket = 'Speculative small-cap monitor' then 'Speculative monitor'
        else 'Insufficient evidence' end as tier0
    from (select *, {anchors} as anchors, list_filter(proof_gaps, lambda x: list_contains({SEVERE}, x)) as severe
      from quality)))"""


TRADING_ONLY = (
    "(contains(lower(x), 'intraday momentum') or x in ('Live price available from Nasdaq Nordic', "
    "'High live turnover', 'Moderate live turnover'))"
)
EVENT = (
    f"(not {TRADING_ONLY} and regexp_matches(lower(x), 'announced|contract|customer|earnings|"
    "guidance|launch|order|partnership|release|report|result|tender|win'))"
)
RELEVANT = (
    "(contains(lower(x), 'intraday momentum') or x in ('High live turnover', 'Moderate live turnover') "
    f"or {EVENT})"
)
SETUP = (
    "(contains(ct, 'high live turnover') or contains(ct, 'strong intraday momentum') or "
    "(contains(ct, 'positive intraday momentum') and contains(ct, 'moderate live turnover')) or "
    f"len(list_filter(catalysts, lambda x: {EVENT})) > 0)"
)
ANCHOR = (
    "(coalesce(pe_ratio <= 18, false) or coalesce(price_to_book <= 2, false) or "
    "coalesce(net_cash_eur_m > 0, false) or coalesce(operating_margin_pct > 0, false) or "
    "coalesce(revenue_growth_pct > 0, false) or coalesce(debt_to_equity <= 0.5e0, false))"
)
SPIKE = "(contains(ct, 'extreme intraday spike') or contains(rt, 'extreme intraday spike'))"
MISSING = "(contains(ct, 'missing live turnover') or contains(rt, 'missing live turnover'))"
NEGATIVE = points(
    (SPIKE, 18), (MISSING, 12),
    ("(contains(ct, 'low live turnover') or contains(rt, 'low live turnover'))", 10),
    ("(contains(ct, 'speculative low-price share') or contains(rt, 'speculative low-price share'))", 8),
)


def dedupe(items: str) -> str:
    return (
        f"list_transform(list_filter(list_zip({items}, range(len({items}))), lambda p: "
        f"list_position(list_transform({items}, lambda y: lower(trim(y))), lower(trim(p[1]))) = p[2] + 1), lambda p: p[1])"
    )


ALL = ("balanced", "long-term", "trading", "momentum", "discovery")


def scored_ctes(source: str = "research", strategies: tuple[str, ...] = ALL, extra: str = "") -> str:
    """base, (valued, quality, gated) and scored: one row per company and strategy."""
    long_term = "long-term" in strategies
    ctes = base_cte(source)
    if long_term:
        ctes += "," + quality_ctes("base")
    keep = (
        "name, ticker, country, exchange, segment, sector, market_cap_eur_m, ordinal, catalysts, risks, ct, rt, "
        "business_description, data_quality, " + ", ".join(METRICS)
        + (", tier, bucket, proof_gaps" if long_term else "") + extra
    )
    parts = []
    for s in strategies:
        up, down = "0e0", "0e0"
        value, discovery, reasons = "value", "discovery", "reasons"
        if s in ("balanced", "discovery", "trading"):
            down = NEGATIVE
        if s == "trading":
            up = points(("contains(ct, 'high live turnover')", 6), ("contains(ct, 'moderate live turnover')", 3), ("contains(ct, 'strong intraday momentum')", 5))
            down = f"({NEGATIVE} + {points((SPIKE, 8))})"
            value, discovery = rd("value * 0.15e0", 2), rd("discovery * 0.25e0", 2)
            reasons = f"list_filter(reasons, lambda x: {RELEVANT})"
        if s == "discovery":
            up = points(("segment = 'first_north'", 4))
            down = f"({NEGATIVE} + {points((f'({SPIKE} or {MISSING})', 10))})"
        if s == "long-term":
            intraday = "(contains(ct, 'intraday momentum') or contains(rt, 'intraday momentum'))"
            spike = "contains(rt, 'extreme intraday spike')"
            promoted = "tier in ('High-conviction candidate', 'Fundamental watchlist')"
            reasons = dedupe(
                f"list_concat(list_concat(list_filter(reasons, lambda x: not {TRADING_ONLY}), "
                f"case when {promoted} then ['Gate tier: ' || tier] else [] end), list_concat([bucket], quality_reasons))"
            )
            warnings = dedupe(
                f"list_concat(list_concat(list_concat(warnings, proof_gaps), case when {intraday} or {spike} then "
                f"['long-term strategy penalty applied'] else [] end), list_concat(case when {intraday} and not {ANCHOR} "
                f"then ['missing long-term fundamental support'] else [] end, case when {promoted} then [] else ['Gate tier: ' || tier] end))"
            )
            parts.append(f"""select {keep}, 'long-term' as strategy, value, {rd('discovery * 0.35e0', 2)} as discovery,
              least(8e0 * len(list_filter(catalysts, lambda x: not {TRADING_ONLY})), 16e0) + quality_adjustment as catalyst,
              risk_penalty + proof_penalty + {points((intraday, 18), (spike, 18), (f'{intraday} and not {ANCHOR}', 12))} as risk_penalty,
              data_quality_penalty, {reasons} as reasons, {warnings} as warnings from gated""")
            continue
        note = f"['{s} strategy adjustment applied']"
        parts.append(f"""select {keep}, '{s}' as strategy, {value} as value, {discovery} as discovery,
          catalyst + {up} as catalyst, risk_penalty + {down} as risk_penalty, data_quality_penalty,
          list_concat({reasons}, case when {up} <> 0 then {note} else [] end) as reasons,
          list_concat(warnings, case when {down} <> 0 then {note} else [] end) as warnings
          from {'gated' if long_term else 'base'}""")
    union = " union all ".join(parts)
    total = rd("value + discovery + catalyst - risk_penalty - data_quality_penalty", 2)
    return ctes + f""",
scored as (select *, {total} as total from ({union}))"""


KEY = (
    "coalesce(nullif(trim(regexp_replace(trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g')), "
    "'(^| )((ab|ag|corp|corporation|inc|limited|ltd|oy|oyj|plc|publ|a|b)( |$))+$', '')), ''), {fallback})"
)
COMPANY_KEY = KEY.format(name="name", fallback="ticker || '|' || country")
BASE = "with" + LISTING + "," + QUOTE + "," + FINANCIALS
RESEARCH = BASE + "," + research_cte()
TIER_ORDER = (
    "case tier when 'High-conviction candidate' then 0 when 'Fundamental watchlist' then 1 "
    "when 'Speculative monitor' then 2 else 3 end"
)


def deduped(source: str = "scored", where: str = "true") -> str:
    return f"""
ideas as (
  select * from (select *, row_number() over (partition by strategy, {COMPANY_KEY} order by total desc, ticker, ordinal) as cr
    from {source} where {where}) where cr = 1)"""


SCORE_OUT = (
    "strategy, ticker, country, value, discovery, catalyst, risk_penalty, data_quality_penalty, total, "
    f"{joined('reasons')} as reasons, {joined('warnings')} as warnings"
)


def watchlist_sql(strategy: str, limit: int = 20, where: str = "true") -> str:
    if strategy == "trading":
        where += f" and {SETUP}"
    order = f"{TIER_ORDER}, total desc, ticker, ordinal" if strategy == "long-term" else "total desc, ticker, ordinal"
    tail = ", tier" if strategy == "long-term" else ""
    return RESEARCH + "," + scored_ctes("research", (strategy,)) + "," + deduped(where=where) + f"""
select {SCORE_OUT}{tail}, rank from (select *, row_number() over (order by {order}) as rank from ideas) where rank <= {limit}"""


ORACLES: dict[str, str] = {}


def _register() -> None:
    add = ORACLES.__setitem__
    add("live_signals", RESEARCH + f" select ticker, country, {joined('catalysts')} as catalysts, {joined('risks')} as risks from research")
    score = SCORE_OUT.replace("strategy, ", "", 1)
    add("base_score", RESEARCH + "," + base_cte() + f" select {score} from base")
    add("strategy_scores", RESEARCH + "," + scored_ctes() + f" select {SCORE_OUT} from scored")
    add("trading_setups", RESEARCH + "," + base_cte() + f"""
select ticker, country, {SETUP} as has_setup, len(list_filter(catalysts, lambda x: {EVENT})) as events,
  len(list_filter(catalysts, lambda x: {TRADING_ONLY})) as trading_only,
  len(list_filter(catalysts, lambda x: {RELEVANT})) as relevant from base""")
    for name, strategy in (
        ("balanced", "balanced"), ("trading", "trading"), ("longterm", "long-term"),
        ("momentum", "momentum"), ("discovery", "discovery"),
    ):
        add(f"watchlist_{name}", watchlist_sql(strategy))
    add("watchlist_filtered", watchlist_sql(
        "balanced",
        where="country = 'SE' and segment <> 'first_north' and market_cap_eur_m between 60 and 900 and lower(trim(sector)) = 'machinery'",
    ))

    ranked = "row_number() over (partition by strategy order by {0})"
    by_score = "total desc, ticker, ordinal"
    by_tier = f"case when strategy = 'long-term' then {TIER_ORDER} else 0 end, {by_score}"

    def quota(limit: int, wanted: dict[str, int], order: str, source: str = "ideas", name: str = "chosen") -> str:
        """Quotas that fit together: best rows of each country first, then overall order."""
        need = "case country " + " ".join(f"when '{k}' then {v}" for k, v in wanted.items()) + " else 0 end"
        return f"""
{name} as (
  select *, {ranked.format(order)} as rank from (
    select *, row_number() over (partition by strategy order by own <= {need} desc, {order}) as pick_row
    from (select *, row_number() over (partition by strategy, country order by {order}) as own from {source}))
  where pick_row <= {limit})"""

    add("watchlist_country_quota", RESEARCH + "," + scored_ctes("research", ("balanced",)) + "," + deduped()
        + "," + quota(20, {"FI": 16, "SE": 3}, by_score) + f" select {SCORE_OUT}, rank from chosen")
    # Two countries: swapping is counting. Each country keeps its best rows.
    add("watchlist_wide_quota", RESEARCH + "," + scored_ctes("research", ("long-term",)) + "," + deduped() + f""",
placed as (select *, row_number() over (order by {by_tier}) as pos,
    row_number() over (partition by country order by {by_tier}) as own from ideas),
n0 as (select count(*) filter (pos <= 10 and country = 'FI') as f, count(*) filter (pos <= 10 and country = 'SE') as s,
    count(*) filter (pos > 10 and country = 'FI') as ff, count(*) filter (pos > 10 and country = 'SE') as fs from placed),
n1 as (select f + w as f, s - w as s, fs from (select *, least(greatest(8 - f, 0), greatest(s - 6, 0), ff) as w from n0)),
n2 as (select f - w as f, s + w as s from (select *, least(greatest(6 - s, 0), greatest(f - 8, 0), fs) as w from n1))
select {SCORE_OUT}, tier, row_number() over (order by {by_tier}) as rank
from placed, n2 where own <= case country when 'FI' then f else s end""")
    add("watchlist_all_strategies", RESEARCH + "," + scored_ctes() + ","
        + deduped(where=f"(strategy <> 'trading' or {SETUP})") + "," + quota(20, {"SE": 12}, by_tier)
        + " select strategy, ticker, country, total, rank from chosen")
    add("watchlist_long_list", RESEARCH + "," + scored_ctes("research", ("balanced", "long-term")) + "," + deduped() + ","
        + quota(1200, {"FI": 700}, by_tier) + " select strategy, ticker, country, total, rank from chosen")
    add("enrichment_budget", RESEARCH + "," + scored_ctes("research", ("balanced", "long-term", "trading")) + ","
        + deduped(where=f"(strategy <> 'trading' or {SETUP})") + "," + quota(20, {"FI": 12}, by_score)
        + " select strategy, ticker, country, total, rank from chosen where rank <= 12")
    add("dedupe_companies", RESEARCH + "," + scored_ctes("research", ("balanced",)) + "," + deduped()
        + f" select {COMPANY_KEY} as company_key, ticker, country, total from ideas")

    add("valuation_support", RESEARCH + "," + valuation_cte("research")
        + " select ticker, country, has_support, is_attractive, primary_kind, primary_value, valuation_summary from valued")
    thesis = """case bucket
  when 'Quality small-cap candidate' then name || ' has multiple long-term quality signals for a small-cap research queue; verify valuation, reporting cadence, and liquidity before acting.'
  when 'Fundamental watchlist candidate' then name || ' has enough fundamental evidence for manual research, but at least one proof gap should be checked before it becomes a high-priority idea.'
  when 'Speculative small-cap monitor' then name || ' is an interesting small-cap monitor, but the long-term case needs more proof because ' || coalesce(lower(proof_gaps[1]), 'the evidence is incomplete') || '.'
  else name || ' lacks enough durable evidence for a strong long-term thesis today; wait for clearer fundamentals, valuation, liquidity, or business evidence.' end"""
    gated = RESEARCH + "," + quality_ctes("research")
    add("quality_assessment", gated + f""" select ticker, country, quality_adjustment, proof_penalty, bucket,
  {joined('quality_reasons')} as quality_reasons, {joined('proof_gaps')} as proof_gaps, {thesis} as thesis from gated""")
    add("longterm_gate", gated + f""" select ticker, country, tier,
  {joined("list_concat(anchors, case when has_support then ['valuation support available'] else [] end)")} as gate_reasons,
  {joined("list_concat(list_transform(severe, lambda x: lower(x)), case when has_support then [] else ['missing valuation support'] end)")} as blockers,
  len(anchors) as anchors, len(severe) as severe_gaps from gated""")
    add("gate_tier_counts", gated + """ select s.sector, t.tier, count(g.ticker) as companies,
  not exists (select 1 from gated h where h.sector = s.sector and h.tier = 'High-conviction candidate') as no_high_conviction
from (select distinct sector from gated) s
cross join (select unnest(['High-conviction candidate', 'Fundamental watchlist', 'Speculative monitor', 'Insufficient evidence']) as tier) t
left join gated g on g.sector = s.sector and g.tier = t.tier group by s.sector, t.tier""")

    def component(name: str, *branches: tuple[str, int, str]) -> str:
        score = " ".join(f"when {t} then {n}" if t else f"else {n}" for t, n, _ in branches)
        view = " ".join(f"when {t} then {v}" if t else f"else {v}" for t, _, v in branches)
        return f"cast(case {score} end as bigint) as {name}_score, case {view} end as {name}_view"

    def at_most(pe, pb, ev):
        return f"((pe_ratio > 0 and pe_ratio <= {pe}) or (price_to_book > 0 and price_to_book <= {pb}) or (ev_to_ebit > 0 and ev_to_ebit <= {ev}))"

    every = "lower(array_to_string(list_concat(list_concat(catalysts, risks), list_concat(reasons, warnings)), '~'))"
    hidden = "('sparse live-source data', 'thin data quality', 'partial data quality', 'missing live turnover', '')"
    public = (
        "list_transform(list_filter(list_concat(risks, warnings), lambda x: lower(trim(x)) not in " + hidden
        + " and not ends_with(lower(trim(x)), ' stated risk(s)') and not ends_with(lower(trim(x)), 'strategy adjustment applied')),"
        " lambda x: upper(trim(x)[1]) || trim(x)[2:])"
    )
    shown = f"lower(array_to_string({public}, ' '))"
    known = " + ".join(
        f"({m} is not null)::int" for m in METRICS if m not in
        ("one_year_return_pct", "distance_from_52w_high_pct", "average_daily_value_eur")
    )
    pct = "printf('%.1f', abs(revenue_growth_pct))"
    valued = scored_ctes("research", ("long-term",), ", valuation_summary, has_support, is_attractive, primary_kind")
    add("conviction_components", RESEARCH + "," + valued + " select ticker, country, " + ", ".join((
        component("business_quality",
            (f"operating_margin_pct >= 15 and {PROFILE}", 5, "'Strong - profitable business with a clear profile.'"),
            (f"operating_margin_pct > 0 and {PROFILE}", 4, "'Good - profitable business with a clear profile.'"),
            ("operating_margin_pct > 0", 3, "'Profitable, but the business profile is limited.'"),
            (f"{PROFILE} and operating_margin_pct is null", 3, "'Clear business profile, but margin data is missing.'"),
            ("operating_margin_pct < 0", 1, "'Weak - profitability is not yet proven.'"),
            ("", 0, "'Insufficient business and margin data.'")),
        component("valuation",
            (at_most(12, "1.2e0", 10), 5, "'Attractive valuation on available P/E or P/B metrics.'"),
            ("is_attractive", 5, "'Attractive valuation support: ' || valuation_summary"),
            (at_most(20, "2.5e0", 16), 4, "'Reasonable valuation on available multiples.'"),
            ("has_support and primary_kind not in ('pe_ratio', 'price_to_book', 'ev_to_ebit')", 3, "'Valuation proxy available: ' || valuation_summary"),
            ("(pe_ratio > 35 or price_to_book > 5 or ev_to_ebit > 25)", 1, "'Expensive on available valuation multiples.'"),
            ("coalesce(pe_ratio, price_to_book, ev_to_ebit) is not null", 2, "'Valuation is available but not clearly attractive.'"),
            ("", 1, "'No valuation multiple is available.'")),
        component("growth",
            ("revenue_growth_pct is null", 1, "'Revenue growth is not available.'"),
            ("revenue_growth_pct >= 20", 5, f"'Strong revenue growth of ' || {pct} || '%.'"),
            ("revenue_growth_pct >= 5", 4, f"'Healthy revenue growth of ' || {pct} || '%.'"),
            ("revenue_growth_pct > 0", 3, f"'Modest revenue growth of ' || {pct} || '%.'"),
            ("", 1, f"'Revenue declined ' || {pct} || '%.'")),
        component("balance_sheet",
            ("net_cash_eur_m > 0 and debt_to_equity <= 0.5e0", 5, "'Net cash and conservative debt/equity.'"),
            ("net_cash_eur_m > 0 or debt_to_equity <= 0.5e0", 4, "'Balance sheet looks conservative on available metrics.'"),
            ("debt_to_equity <= 1.5e0", 3, "'Debt/equity looks manageable on available data.'"),
            ("net_cash_eur_m < 0 or debt_to_equity > 1.5e0", 1, "'Leverage or net debt needs close review.'"),
            ("", 1, "'Balance sheet data is not available.'")),
        component("momentum",
            (f"contains({every}, 'intraday') or contains({every}, 'live turnover') or contains({every}, 'trading strategy') or contains({every}, 'long-term strategy penalty')", 1, "'Intraday move is not enough for a long-term thesis.'"),
            ("one_year_return_pct <= -25 or distance_from_52w_high_pct <= -30", 3, "'Contrarian setup; verify why the market discounted it.'"),
            ("one_year_return_pct >= 75 or distance_from_52w_high_pct >= -5", 2, "'Share price looks hot; do not let momentum drive the thesis.'"),
            ("one_year_return_pct is not null or distance_from_52w_high_pct is not null", 3, "'Price context is available but secondary to fundamentals.'"),
            ("", 2, "'No medium-term price context is available.'")),
        component("risk",
            (f"contains({shown}, 'extreme intraday spike') or contains({shown}, 'speculative low-price')", 1, "'Speculative market signal; position sizing would matter.'"),
            (f"contains({shown}, 'negative operating margin') or contains({shown}, 'profitability')", 2, "'Profitability risk needs manual confirmation.'"),
            (f"contains({shown}, 'low live turnover') or contains({shown}, 'thin liquidity')", 2, "'Liquidity risk could make entry and exit difficult.'"),
            (f"len({public}) > 0", 3, f"array_to_string({public}[1:2], '; ')"),
            ("", 4, "'No specific risk flag surfaced in the current screen.'")),
        component("data_confidence",
            (f"({known}) = 0 and not ({PROFILE})", 0, "'No useful fundamentals or profile text are available today.'"),
            (f"data_quality = 'good' and ({known}) >= 4 and {PROFILE}", 5, "'Rich fundamentals and profile text are available.'"),
            (f"({known}) >= 4 and {PROFILE}", 4, "'Several fundamentals plus profile text are available.'"),
            (f"({known}) >= 2", 3, "'Some fundamentals are available; verify in reports.'"),
            ("", 1, "'Only limited fundamentals are available today.'")),
    )) + " from scored")
    reason = """list_transform(reasons, lambda x: case lower(trim(x))
  when 'trading strategy adjustment applied' then 'Trading strategy boost: liquidity and momentum signals make this more relevant for a short-term watchlist.'
  when 'long-term strategy adjustment applied' then 'Long-term strategy boost: valuation or balance-sheet signals make this more relevant for fundamental research.'
  when 'discovery strategy adjustment applied' then 'Discovery strategy boost: smaller or less-covered listing profile.'
  else upper(trim(x)[1]) || trim(x)[2:] end)"""
    add("public_wording", RESEARCH + "," + scored_ctes("research", ("balanced", "trading", "discovery"))
        + f" select strategy, ticker, country, {joined(public)} as public_risks, {joined(reason)} as public_reasons from scored")
    _register_fundamentals(add, quota, by_score, by_tier)
    _register_ledger(add)
    _register_calendar_and_scans(add)


def _register_fundamentals(add, quota, by_score, by_tier) -> None:
    import re

    k = "c_custkey"
    rate = "case country when 'SE' then 0.1e0 else 1e0 end"
    requests = f"""
requests as (
  select *, replace(ticker, ' ', '') || case country when 'SE' then '.ST' else '.HE' end as symbol, {rate} as rate
  from listing where {k} % 4 <> 1)"""
    cash = f"(case when ({k} + 1) % 6 <> 0 then c_acctbal * 10000e0 end - 50000000e0)"
    margin = f"case when ({k} + 1) % 8 <> 0 then {{}} end"
    nothing = "cast(null as double)"
    summary = f"""
parsed as (
  select c_custkey, ticker, country, symbol,
    {rd(f"case when ({k} + 1) % 7 <> 0 then c_acctbal * 100000e0 end * rate / 1000000e0", 2)} as market_cap_eur_m,
    case when ({k} + 1) % 4 <> 0 then c_acctbal / 150e0 end as pe_ratio,
    case when ({k} + 1) % 5 <> 0 then (c_acctbal + 1000e0) / 1500e0 end as price_to_book,
    {rd(f"{cash} * rate / 1000000e0", 2)} as net_cash_eur_m,
    {rd(f"case when ({k} + 1) % 9 <> 0 then (({k} + 1) % 23) * 10e0 end / 100e0", 4)} as debt_to_equity,
    {rd(f"(({k} % 61) - 20) / 100e0 * 100e0", 2)} as revenue_growth_pct,
    {rd(margin.format(f"(({k} + 1) % 41 - 12) / 100e0") + " * 100e0", 2)} as operating_margin_pct,
    (({k} % 17) * 1000)::double * case when ({k} + 1) % 11 <> 0 then c_acctbal / 100e0 end * rate as average_daily_value_eur,
    {nothing} as one_year_return_pct, {nothing} as distance_from_52w_high_pct
  from requests where {k} % 29 <> 0)"""
    out = (
        "symbol, market_cap_eur_m, pe_ratio, price_to_book, net_cash_eur_m, debt_to_equity, revenue_growth_pct, "
        "operating_margin_pct, average_daily_value_eur, one_year_return_pct, distance_from_52w_high_pct"
    )
    start = "with" + LISTING + "," + requests
    add("payload_quote_summary", start + "," + summary + f" select {out}, 'Yahoo-style fundamentals lookup (' || symbol || ')' as label from parsed")
    add("payload_profile_metrics", start + f"""
select symbol, {rd(f"case when ({k} + 1) % 7 <> 0 then c_acctbal / 3e0 end * rate", 2)} as market_cap_eur_m,
  coalesce(case when ({k} + 1) % 4 <> 0 then c_acctbal / 150e0 end, c_acctbal / 140e0) as pe_ratio,
  case when ({k} + 1) % 5 <> 0 then (c_acctbal + 1000e0) / 1500e0 end as price_to_book, {nothing} as net_cash_eur_m,
  {rd(f"case when ({k} + 1) % 9 <> 0 then (({k} + 1) % 23) * 10e0 end / 100e0", 4)} as debt_to_equity,
  (({k} % 61) - 20)::double as revenue_growth_pct, {margin.format(f"(({k} + 1) % 41 - 12)::double")} as operating_margin_pct,
  {nothing} as average_daily_value_eur, {nothing} as one_year_return_pct, {nothing} as distance_from_52w_high_pct,
  'Finnhub fundamentals lookup (' || symbol || ')' as label from requests""")

    def pct(x: str) -> str:
        return rd(f"case when {x} between -1 and 1 then ({x}) * 100e0 else {x} end", 2)

    add("payload_search", start + f"""
select lower(symbol) as symbol, {rd("c_acctbal * 100000e0 * rate / 1000000e0", 2)} as market_cap_eur_m, {nothing} as pe_ratio,
  {nothing} as price_to_book, {nothing} as net_cash_eur_m, case when ({k} + 1) % 9 <> 0 then (({k} + 1) % 23) / 10e0 end as debt_to_equity,
  {pct(f"(({k} % 61) - 20) / 10e0")} as revenue_growth_pct,
  {pct("coalesce(" + margin.format(f"(({k} + 1) % 41 - 12) / 100e0") + ", 0.5e0)")} as operating_margin_pct,
  {rd(f"(c_acctbal / 100e0) * (({k} % 17) * 1000)::double * rate", 2)} as average_daily_value_eur,
  ({k} % 120 - 60)::double as one_year_return_pct, (-({k} % 80))::double as distance_from_52w_high_pct,
  case when {k} % 3 <> 0 then 'Makes things, no. ' || {k} end as business_description,
  case when {k} % 2 = 0 then 'https://ir.example/' || {k} end as ir_url from requests""")

    suffix = "case country when 'SE' then '.ST' else '.HE' end"
    add("symbol_candidates", "with" + LISTING + f"""
select ticker, country, 0::bigint as attempt, replace(ticker, ' ', '-') || {suffix} as symbol from listing
union all select ticker, country, 1, replace(ticker, ' ', '') || {suffix} from listing where contains(ticker, ' ')""")
    hits = ", hits as (select *, case when contains(ticker, ' ') then 1 else 0 end as hit_attempt from parsed)"
    add("first_hit_fundamentals", start + "," + summary + hits + f" select ticker, country, hit_attempt::bigint as hit_attempt, {out} from hits")
    fill = [m for m in METRICS if m not in ("one_year_return_pct", "distance_from_52w_high_pct")]
    own = ("pe_ratio price_to_book net_cash_eur_m debt_to_equity revenue_growth_pct operating_margin_pct average_daily_value_eur").split()
    filled = " or ".join(f"(r.{m} is null and h.{m} is not null)" for m in ["market_cap_eur_m", *own])

    def merged(source: str, test: str, extra: str = "") -> str:
        numbers = ", ".join(
            f"case when {test} then coalesce(r.{m}, h.{m}) else r.{m} end as {m}" if m in own else f"r.{m}" for m in METRICS
        )
        return f"""select r.* exclude ({', '.join(METRICS)}, market_cap_eur_m, data_quality), {numbers},
    case when {test} then coalesce(r.market_cap_eur_m, h.market_cap_eur_m) else r.market_cap_eur_m end as market_cap_eur_m,
    case when r.data_quality = 'thin' and {test} and ({filled}) then 'partial' else r.data_quality end as data_quality,
    (1 + case when {test} and h.c_custkey is not null then 1 else 0 end)::bigint as n_evidence{extra}
  from {source} r left join hits h on h.c_custkey = r.c_custkey"""

    blank = BASE + "," + research_cte(blank_thin=True) + "," + requests + "," + summary + hits
    add("fundamentals_merge", blank + f"""
select ticker, country, market_cap_eur_m, {', '.join(METRICS)}, data_quality, n_evidence from ({merged('research', 'true')})""")
    two = ("balanced", "long-term")
    second = re.sub(r"(?<!data )\b(base|valued|quality|gated|scored|proxies_valued|ideas)\b", r"\1_2",
                    scored_ctes("rebuilt", two, ", n_evidence, chosen_for") + "," + deduped(where="strategy = chosen_for"))
    add("watchlist_enriched", blank + "," + scored_ctes("research", two) + "," + deduped() + ","
        + quota(20, {"FI": 12}, by_score, "ideas", "first_choice") + f""",
demand as (select strategy, ticker as t, country as co from first_choice where rank <= 15),
both_ways as (select x.*, s.chosen_for, d.t is not null as wanted from research x
  cross join (select unnest(['balanced', 'long-term']) as chosen_for) s
  left join demand d on d.strategy = s.chosen_for and d.t = x.ticker and d.co = x.country),
rebuilt as ({merged('both_ways', 'r.wanted')}),""" + second + ","
        + quota(20, {"FI": 12}, by_tier, "ideas_2", "final_choice")
        + f" select {SCORE_OUT}, data_quality, n_evidence, rank from final_choice")
    add("source_coverage", start + f"""
select 'free fundamentals' as source, attempted, parsed, case when parsed = attempted then 'ok' else 'warning' end as status,
  parsed || '/' || attempted || ' Yahoo-style lookups parsed' as detail
from (select sum(case when contains(ticker, ' ') then 2 else 1 end)::bigint as attempted,
  count(*) filter ({k} % 4 <> 1 and {k} % 29 <> 0) as parsed from listing)
union all
select 'finnhub fundamentals', attempted, parsed, case when parsed = attempted then 'ok' else 'warning' end,
  parsed || '/' || attempted || ' Finnhub lookups parsed'
from (select sum(case when contains(ticker, ' ') then 2 else 1 end)::bigint as attempted,
  count(*) filter ({k} % 4 <> 1) as parsed from listing)
union all
select 'finimpulse fundamentals', attempted, parsed, case when parsed = attempted then 'ok' else 'warning' end,
  parsed || '/' || attempted || ' Finimpulse lookups parsed'
from (select sum(case when contains(ticker, ' ') then 2 else 1 end)::bigint as attempted,
  count(*) filter ({k} % 4 <> 1) as parsed from listing)
union all
select 'nasdaq nordic live data', n + 1, n, 'warning', n || ' companies parsed from file:customer, 1 files unreadable'
from (select count(distinct (case when c_custkey % 13 = 5 then c_custkey - 2 else c_custkey end, country)) as n from listing)""")


USERS = """
daily as (
  select user_id, cast(ts as date) as d, arg_max(value, event_id) as lv,
    count(*) filter (event_type = 'purchase') as purchases, count(*) filter (event_type = 'error') as errors,
    count(*) filter (event_type = 'click') as clicks
  from events group by all),
quotes as (
  select user_id, d, 'U' || user_id as ticker, case when user_id % 2 = 0 then 'SE' else 'FI' end as country,
    'Firm ' || (user_id // 2) || ' AB' as name, case when user_id % 3 = 0 then 'first_north' else 'main_market' end as segment,
    case when user_id % 50 <> 7 then lv end as price, case when user_id % 2 = 0 then 'SEK' else 'EUR' end as currency,
    purchases > 0 as mover, errors > 0 as selloff, clicks > 0 as active
  from daily),
snaps as (select * from quotes where price is not null),
picks as (
  select q.user_id, q.d, strategy, q.d::varchar || '|' || strategy || '|' || country || '|' || ticker as pick_id, ticker, country,
    name, segment, price as entry_price, case when q.user_id % 20 = 0 then 'EUR' else currency end as entry_currency,
    '../reports/' || strategy || '.html' as report_url, (q.user_id % 90)::double as score_total
  from (select distinct user_id, cast(ts as date) as d, case event_type when 'signup' then 'trading' else 'long-term' end as strategy
        from events where event_type in ('signup', 'view')) e
  join quotes q on q.user_id = e.user_id and q.d = e.d),
due as (
  select p.*, h.horizon, h.n, list_filter(generate_series(p.d + 1, p.d + 100, interval 1 day), lambda x: isodow(x) < 6)[h.n]::date as due_date
  from picks p cross join (values ('1d', 1), ('5d', 5), ('20d', 20), ('60d', 60)) h(horizon, n))"""
def outcome_ctes(entry_snapshots: str = "snaps") -> str:
    """Picks, due days, benchmark and outcomes. A ledger knows the snapshots of its run days only."""
    return USERS + f""",
spans as (select distinct country, d, due_date from due),
bench as (
  select s.country, s.d, s.due_date, count(*) as peers,
    {rd("sum(cast((b.price - a.price) / a.price * 100e0 as decimal(24,8)))::double / count(*)", 2)} as benchmark_return_pct
  from spans s join {entry_snapshots} a on a.country = s.country and a.d = s.d and a.price <> 0
  join snaps b on b.ticker = a.ticker and b.country = a.country and b.currency = a.currency and b.d = s.due_date
  group by s.country, s.d, s.due_date),
runs as (select distinct cast(ts as date) as r from events where day(ts) <> 17),
decided as (
  select due.*, (select min(r) from runs where r >= due.due_date) as as_of_date from due),
outcomes as (
  select *, case when status = 'priced' then benchmark end as benchmark_return_pct,
    case when status = 'priced' and benchmark is not null then 'Equal-weight ' || country || ' market' end as benchmark_label,
    case when status = 'priced' then {rd("return_pct - benchmark", 2)} end as excess_return_pct
  from (select *, case when status = 'priced' then {rd("(price - entry_price) / entry_price * 100e0", 2)} end as return_pct
    from (select x.* , q.price as qp, b.benchmark_return_pct as benchmark,
        case when as_of_date is null then 'not_due' when as_of_date > x.due_date then 'missed_window'
          when q.price is null or entry_price is null or entry_price = 0 or q.currency is distinct from entry_currency then 'missing_price'
          else 'priced' end as status,
        case when as_of_date = x.due_date then q.price end as price,
        case when as_of_date = x.due_date and q.price is not null then q.currency end as currency
      from decided x left join quotes q on q.ticker = x.ticker and q.country = x.country and q.d = x.due_date
      left join bench b on b.country = x.country and b.d = x.d and b.due_date = x.due_date)))"""


OUTCOME = outcome_ctes()
RUN_OUTCOME = outcome_ctes("(select * from snaps where day(d) <> 17)")


def _register_ledger(add) -> None:
    users, outcome = "with" + USERS, "with" + OUTCOME
    add("due_dates", users + " select pick_id, horizon, due_date::varchar as due_date from due")
    add("weekday_arithmetic", """
with days as (select unnest(generate_series(min(o_orderdate)::date, max(o_orderdate)::date, interval 1 day))::date as d from orders)
select d::varchar as day, n::bigint as n, list_filter(generate_series(d + 1, d + 100, interval 1 day), lambda x: isodow(x) < 6)[n]::date::varchar as due
from days cross join (values (1), (5), (20), (60)) h(n)""")
    outcome_rows = """ select pick_id, horizon, due_date::varchar as due_date, {} as as_of_date, status,
  price, currency, return_pct, benchmark_label, benchmark_return_pct, excess_return_pct from outcomes"""
    add("outcomes", outcome + outcome_rows.format("as_of_date::varchar"))
    for name in ("stream_settlement", "ledger_daily_update"):
        add(name, "with" + RUN_OUTCOME + outcome_rows.format("case when status <> 'not_due' then as_of_date::varchar end"))
    add("country_benchmark", outcome + """ select country, d::varchar as report_date, due_date::varchar as due_date, peers,
  benchmark_return_pct from bench""")
    add("ledger_upsert", outcome + """,
locked as (select distinct pick_id from outcomes where status = 'priced'),
old as (select * from picks where d < (select max(d) from picks))
select p.pick_id,
  case when strategy <> 'long-term' then entry_price when o.pick_id is not null and l.pick_id is not null then entry_price else entry_price + 1e0 end as entry_price,
  case when strategy <> 'long-term' or (o.pick_id is not null and l.pick_id is not null) then p.d::varchar else 'later' end as entry_timestamp,
  case when strategy <> 'long-term' then p.score_total else p.score_total + 5e0 end as score_total
from picks p left join (select pick_id from old) o using (pick_id) left join locked l using (pick_id)
where strategy = 'long-term' or o.pick_id is not null""")
    mean = lambda x: rd(f"sum(round({x} * 100e0)::hugeint)::double / 100e0 / nullif(count({x}), 0)", 2)
    share = lambda t, n: rd(f"count(*) filter ({t}) / nullif({n}, 0)::double * 100e0", 1)
    middle = "list_sort(list(return_pct))"
    stats = f""",
done as (select * from outcomes where status = 'priced' and return_pct is not null),
stats as (
  select strategy, horizon, count(*) as completed, {share('return_pct > 0', 'count(*)')} as hit_rate_pct,
    {mean('return_pct')} as average_return_pct,
    {rd(f"({middle}[(count(*) + 1) // 2] + {middle}[(count(*) + 2) // 2]) / 2e0", 2)} as median_return_pct,
    min(return_pct) as worst_return_pct, {share('return_pct < 0', 'count(*)')} as loss_rate_pct,
    count(*) filter (return_pct <= -10) as large_loser_count, {rd('stddev_pop(return_pct)', 2)} as volatility_pct,
    {mean('benchmark_return_pct')} as average_benchmark_return_pct, {mean('excess_return_pct')} as average_excess_return_pct,
    {share('excess_return_pct > 0', 'count(excess_return_pct)')} as excess_hit_rate_pct
  from done group by strategy, horizon),
horizons as (
select s.strategy, h.horizon, h.n::bigint as horizon_days, coalesce(completed, 0) as completed, hit_rate_pct, average_return_pct,
  median_return_pct, worst_return_pct, loss_rate_pct, coalesce(large_loser_count, 0) as large_loser_count, volatility_pct,
  average_benchmark_return_pct, average_excess_return_pct, excess_hit_rate_pct
from (values ('trading'), ('long-term')) s(strategy) cross join (values ('1d', 1), ('5d', 5), ('20d', 20), ('60d', 60)) h(horizon, n)
left join stats t on t.strategy = s.strategy and t.horizon = h.horizon)"""
    add("horizon_scorecard", outcome + stats + " select * from horizons")

    long_term = "strategy = 'long-term'"
    bucket = "case when user_id % 9 <> 0 then case when user_id % 2 = 0 then 'Quality small-cap candidate' else 'Speculative small-cap monitor' end end"
    tier = "['High-conviction candidate', 'Fundamental watchlist', 'Speculative monitor', 'Insufficient evidence'][user_id % 4 + 1]"
    signals = kept(
        "'country:' || country", "'segment:' || segment",
        when("user_id % 3 = 0", "'reason:Positive operating margin'"),
        when("user_id % 4 = 0", "'reason:Net cash balance sheet'"),
        when("user_id % 5 = 0", "'reason:Revenue growth'"),
        when(f"not {long_term}", "'reason:High live turnover'"),
        when(f"({long_term} or user_id % 11 = 0) and not ({long_term} and ({bucket}) is not null)", f"'bucket:' || coalesce({bucket}, 'None')"),
        when(long_term, f"'gate:' || {tier}"),
        when(long_term, "'gate_durable_anchors:' || (user_id % 5)"),
        when(long_term, "'gate_severe_proof_gaps:' || (user_id % 3)"),
        when(f"{long_term} and user_id % 6 <> 0", "'valuation_proxy:pe_ratio'"),
        when(f"{long_term} and ({bucket}) is not null", f"'quality_bucket:' || {bucket}"),
        when(f"{long_term} and user_id % 3 = 0", "'quality:positive operating margin'"),
        when(f"{long_term} and user_id % 4 = 0", "'quality:conservative balance sheet'"),
        when(f"{long_term} and user_id % 5 = 0", "'quality:revenue growth'"),
        when(f"{long_term} and user_id % 7 = 0", "'proof_gap:thin liquidity'"),
        when(f"{long_term} and user_id % 6 = 5", "'proof_gap:no growth signal'"),
    )
    attributed = f""",
rated as (select pick_id, any_value(strategy) as strategy, any_value(user_id) as user_id, any_value(country) as country,
    any_value(segment) as segment, arg_max(return_pct, n) as r
  from outcomes where status = 'priced' and return_pct is not null group by pick_id),
exploded as (
  select strategy as scope, unnest({signals}) as signal, r from rated
  union all select 'all', unnest(list_append({signals}, 'strategy:' || strategy)), r from rated),
attributed as (
  select scope, signal, count(*) as observations, {mean('r')} as average_return_pct, {share('r > 0', 'count(*)')} as hit_rate_pct
  from exploded group by scope, signal),
placed as (select *, row_number() over (partition by scope order by observations desc, signal) as place from attributed)"""
    attribution = outcome + attributed
    add("signal_attribution", attribution + " select scope, signal, observations, average_return_pct, hit_rate_pct from attributed")
    label = """(case split_part(signal, ':', 1) when 'bucket' then 'Bucket: ' when 'country' then 'Country: ' when 'gate' then 'Gate: '
  when 'gate_durable_anchors' then 'Gate durable anchors: ' when 'gate_severe_proof_gaps' then 'Gate severe proof gaps: '
  when 'proof_gap' then 'Proof gap: ' when 'quality' then 'Quality: ' when 'quality_bucket' then 'Bucket: ' when 'reason' then 'Reason: '
  when 'segment' then 'Segment: ' when 'strategy' then 'Strategy: ' else 'Valuation proxy: ' end
  || case when split_part(signal, ':', 1) in ('gate', 'gate_durable_anchors', 'gate_severe_proof_gaps', 'quality_bucket') then split_part(signal, ':', 2)
    else upper(split_part(signal, ':', 2)[1]) || replace(split_part(signal, ':', 2)[2:], '_', ' ') end)"""
    add("top_signals", attribution + f" select scope, signal, {label} as label, place as rank from placed where place <= 12")
    pct = "regexp_replace(printf('%.2f', abs(average_return_pct)), '\\.?0+$', '') || '%'"
    add("learning_suggestions", attribution + f""",
able as (select *, row_number() over (partition by scope order by observations desc, signal) as best from attributed where observations >= 10)
select s.scope, coalesce(best, 1)::bigint as rank, coalesce({label} || ' has produced a ' || case when average_return_pct > 0 then 'positive' else 'negative' end
  || ' average return of ' || case when average_return_pct > 0 then '+' when average_return_pct < 0 then '-' else '' end || {pct}
  || ' across ' || observations || ' completed observations. Review whether its scoring weight should change.',
  'No learning suggestions yet. At least 10 completed observations are needed for a signal.') as suggestion
from (values ('all'), ('trading'), ('long-term')) s(scope) left join (select * from able where best <= 5) a on a.scope = s.scope""")

    def ranked(direction: str, name: str) -> str:
        key = KEY.format(name="name", fallback="''")
        order = f"return_pct {direction}, pick_id, n"
        return f"""
{name} as (select * from (select *, row_number() over (partition by scope order by {order}) as rank
  from (select *, row_number() over (partition by scope, k order by {order}) as one from
    (select o.*, {key} as k, unnest(['all', strategy]) as scope from outcomes o where status = 'priced' and return_pct is not null))
  where one = 1) where rank <= 5)"""

    line = "scope, pick_id, name, ticker, strategy, horizon, return_pct, report_url, rank"
    add("best_picks", outcome + "," + ranked("desc", "best") + f" select {line} from best")
    add("worst_picks", outcome + "," + ranked("desc", "best") + "," + ranked("asc", "worst")
        + f" select {line} from worst w where not exists (select 1 from best b where b.scope = w.scope and b.k = w.k)")
    tone = """case when positive_movers >= 2 and positive_movers >= selloffs * 2 then 'Risk-on / broad momentum'
  when selloffs >= 2 and selloffs >= positive_movers * 2 then 'Risk-off / broad selloff' else 'Mixed / quiet' end as tone"""
    context = users + f""", context as (select *, {tone} from (select d::varchar as snapshot_date, count(*) as companies,
  count(*) filter (mover) as positive_movers, count(*) filter (selloff) as selloffs, count(*) filter (active) as active_turnover
  from snaps group by d))"""
    add("daily_market_context", context + " select * from context")
    add("market_context", context + " select * from context where snapshot_date = (select max(d)::varchar from snaps)")
    def figures(frame: str, source: str, keys: str, names: str) -> str:
        cells = ", ".join(f"{{figure: '{n}', value: {n}::double}}" for n in names.split())
        return f"select '{frame}' as frame, {keys} as item, unnest([{cells}], recursive := true) from {source}"

    add("ledger_summary", "with" + RUN_OUTCOME + stats + attributed + "," + ranked("desc", "best") + "," + ranked("asc", "worst") + f""",
worst_only as (select w.* from worst w where not exists (select 1 from best b where b.scope = w.scope and b.k = w.k)),
lists as (select 'best' as list, * from best union all select 'worst', * from worst_only),
seen as (select * from snaps where day(d) <> 17),
context as (select *, {tone} from (select d::varchar as snapshot_date, count(*) as companies, count(*) filter (mover) as positive_movers,
  count(*) filter (selloff) as selloffs, count(*) filter (active) as active_turnover from seen where d = (select max(d) from seen) group by d)),
tiered as (select d::varchar as d, {tier} as tier, count(*) as n from picks where {long_term} group by all),
tiers as (select days.d, t.tier, coalesce(n, 0) as companies from (select distinct d from tiered) days
  cross join (select unnest(['High-conviction candidate', 'Fundamental watchlist', 'Speculative monitor', 'Insufficient evidence']) as tier) t
  left join tiered x on x.d = days.d and x.tier = t.tier)
""" + " union all ".join([
        figures("horizons", "horizons", "strategy || '|' || horizon", "completed hit_rate_pct average_return_pct median_return_pct worst_return_pct "
                "loss_rate_pct large_loser_count volatility_pct average_benchmark_return_pct average_excess_return_pct excess_hit_rate_pct"),
        figures("signals", "attributed", "scope || '|' || signal", "observations average_return_pct hit_rate_pct"),
        figures("context", "context", "snapshot_date || '|' || tone", "companies positive_movers selloffs active_turnover"),
        figures("tiers", "tiers", "d || '|' || tier", "companies"),
        figures("ranked", "lists", "list || '|' || scope || '|' || pick_id || '|' || horizon", "rank return_pct"),
        figures("latest", "(select pick_id, r as latest_return_pct from rated)", "pick_id", "latest_return_pct"),
    ]))
    add("stream_ledger_update", users + " select pick_id, entry_price, entry_currency, score_total, 4::bigint as open_outcomes from picks")
    add("stream_market_context", f"""
with last as (select arg_max(event_type, ts) as kind, cast(ts as date) as d from events where user_id % 50 <> 7 group by user_id, cast(ts as date))
select *, {tone} from (select d::varchar as snapshot_date, count(*) as companies, count(*) filter (kind = 'purchase') as positive_movers,
  count(*) filter (kind = 'error') as selloffs, count(*) filter (kind = 'click') as active_turnover
from last group by d)""")


def _register_calendar_and_scans(add) -> None:
    days = """
days as (select unnest(generate_series(min(o_orderdate)::date, max(o_orderdate)::date, interval 1 day))::date as d from orders),
e0 as (select d, year(d) as y, year(d) % 19 as g, year(d) // 100 as ce from days),
e1 as (select *, (ce - ce // 4 - (ce - (ce - 17) // 25) // 3 + 19 * g + 15) % 30 as i0 from e0),
e2 as (select *, i0 - (i0 // 28) * (1 - (i0 // 28) * (29 // (i0 + 1)) * ((21 - g) // 11)) as i from e1),
e3 as (select *, i - (y + y // 4 + i + 2 - ce + ce // 4) % 7 as l from e2),
e4 as (select d, make_date(y, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) as easter from e3),
calendar as (
  select d, market, case when isodow(d) >= 6 then 'Weekend'
    when strftime(d, '%m-%d') = '06-06' and market = 'stockholm' then 'Swedish National Day'
    when strftime(d, '%m-%d') = '12-06' and market = 'helsinki' then 'Finnish Independence Day'
    when strftime(d, '%m-%d') = '01-01' then 'New Year''s Day' when strftime(d, '%m-%d') = '01-06' then 'Epiphany'
    when d = easter - 2 then 'Good Friday' when d = easter + 1 then 'Easter Monday' when d = easter + 39 then 'Ascension Day'
    when strftime(d, '%m-%d') = '05-01' then 'May Day'
    when month(d) = 6 and day(d) between 19 and 25 and isodow(d) = 5 then 'Midsummer Eve'
    when strftime(d, '%m-%d') = '12-24' then 'Christmas Eve' when strftime(d, '%m-%d') = '12-25' then 'Christmas Day'
    when strftime(d, '%m-%d') = '12-26' then 'Boxing Day' when strftime(d, '%m-%d') = '12-31' then 'New Year''s Eve' end as reason
  from e4 cross join (values ('stockholm'), ('helsinki')) m(market))"""
    add("market_calendar", "with" + days + " select d::varchar as day, market, reason is null as is_open, reason from calendar")
    add("markets_open", "with" + days + " select d::varchar as day, bool_and(reason is null) as all_open from calendar group by d")

    def one(x: str, label: str) -> str:
        return f"'{label} is ' || printf('%.1f', {x}) || '%'"

    facts = kept(
        "'Market cap is about EUR ' || case when abs(market_cap_eur_m) >= 100 then printf('%.0f', market_cap_eur_m) else printf('%.1f', market_cap_eur_m) end || 'm'",
        one("revenue_growth_pct", "revenue growth"), one("operating_margin_pct", "operating margin"), one("one_year_return_pct", "one-year return"),
    )
    label = "case segment when 'first_north' then 'First North' when 'main_market' then 'main market' when 'spotlight' then 'Spotlight' else 'public market' end"
    view = kept(
        "case when price is not null then case when ordinal % 2 = 0 then 'Live price is ' || printf('%g', price) || ' ' || price_currency || ' from Nasdaq Nordic.' else 'Price is ' || printf('%g', price) || ' ' || price_currency || '.' end end",
        "case when pe_ratio > 0 then 'P/E is ' || printf('%g', pe_ratio) || '.' else 'P/E is unavailable in the current dataset.' end",
        "case when price_to_book is not null then 'Price/book is ' || printf('%g', price_to_book) || '.' else 'Price/book is unavailable in the current dataset.' end",
        "case when net_cash_eur_m is null then 'Net cash or net debt is unavailable in the current dataset.' when net_cash_eur_m >= 0 then 'Net cash is EUR ' || printf('%g', net_cash_eur_m) || 'm.' else 'Net debt is EUR ' || printf('%g', abs(net_cash_eur_m)) || 'm.' end",
    )
    add("company_profile", RESEARCH + "," + base_cte() + f""",
f as (select *, {facts} as facts from base)
select ticker, country, total, name || ' is a ' || country || '-listed ' || coalesce(sector, 'unknown sector') || ' company on ' || exchange || '.' as business_summary,
  name || ' is a ' || case country when 'SE' then 'Sweden' else 'Finland' end || '-listed ' || {label} || ' ' || sector || ' company on ' || exchange || '.'
    || case len(facts) when 0 then '' when 1 then ' ' || facts[1] || '.' when 2 then ' ' || facts[1] || ' and ' || facts[2] || '.'
       else ' ' || array_to_string(facts[1:len(facts) - 1], ', ') || ', and ' || facts[len(facts)] || '.' end as presentation,
  {joined(view)} as valuation_view,
  case when len(reasons) > 0 then {joined('reasons')} else 'Scoring did not surface a specific reason; manual triage is needed.' end as why_it_appeared,
  case when len(catalysts) > 0 then {joined('catalysts')} else 'No explicit catalyst is available in the current research fixture.' end as bull_case,
  case when len(risks) > 0 then {joined('risks')} else 'No explicit risk is available in the current research fixture.' end as bear_case
from f""")
    add("curated_scan", RESEARCH + f"""
select name, upper(trim(ticker)) as ticker, country, exchange, segment, sector, market_cap_eur_m, listing_currency, price, price_currency,
  pe_ratio, data_quality, {joined('catalysts')} as catalysts from research""")
    add("profile_sink", RESEARCH + """
select ticker, country, name, case when ordinal % 9 <> 0 then price end as price, pe_ratio,
  name || ' is a ' || country || '-listed ' || coalesce(sector, 'unknown sector') || ' company on ' || exchange || '.' as business_summary
from research""")
    add("iso_dates", """
select o_orderkey, text, case when o_orderkey % 7 > 1 then text end as day
from (select o_orderkey, case o_orderkey % 7 when 0 then '1998-02-30' when 1 then 'May 11' else o_orderdate::date::varchar end as text from orders)""")
    add("json_listing_scan", "with" + LISTING + "," + QUOTE + """
select name, ticker, country, exchange, segment, sector, listing_currency, price, percentage_change, turnover, volume from (
  select l.name, 'C' || case when c_custkey % 13 = 5 then c_custkey - 2 else c_custkey end as ticker, l.country, 'Exchange ' || l.country as exchange,
    l.segment, l.sector, l.listing_currency, q.price, q.percentage_change, q.turnover, q.volume,
    row_number() over (partition by 'C' || case when c_custkey % 13 = 5 then c_custkey - 2 else c_custkey end, l.country
      order by c_custkey // 500, l.segment, c_custkey) as copy
  from listing l left join quote q using (c_custkey)) where copy = 1""")
    for name in ("csv_listing_scan", "csv_mixed_headers"):
        add(name, "with" + LISTING + """
select name, ticker, country, case when c_custkey % 3 = 0 then exchange else 'Nasdaq Nordic' end as exchange, segment, sector, listing_currency
from listing where c_custkey % 10 <> 3""")
    add("latest_listing", "with" + LISTING + """
select ticker, country, segment, name from (
  select 'C' || (c_custkey // 3) as ticker, country, segment, name,
    row_number() over (partition by c_custkey // 3, country
      order by case segment when 'main_market' then 0 when 'first_north' then 1 when 'spotlight' then 2 else 3 end, c_custkey) as copy
  from listing) where copy = 1""")
    growth = """case when revenue_growth_pct is null then 'Revenue growth is not available.'
  when revenue_growth_pct >= 20 then 'Strong revenue growth of ' || printf('%.1f', revenue_growth_pct) || '%.'
  when revenue_growth_pct >= 5 then 'Healthy revenue growth of ' || printf('%.1f', revenue_growth_pct) || '%.'
  when revenue_growth_pct > 0 then 'Modest revenue growth of ' || printf('%.1f', revenue_growth_pct) || '%.'
  else 'Revenue declined ' || printf('%.1f', abs(revenue_growth_pct)) || '%.' end"""
    lists = scored_ctes("research", ("trading", "long-term"), ", price, price_currency, anchors")
    add("report_scan", RESEARCH + "," + lists + "," + deduped(where=f"(strategy <> 'trading' or {SETUP})") + f"""
select '2024-02-01|' || strategy || '|' || country || '|' || upper(ticker) as pick_id, rank, upper(ticker) as ticker, country, price as entry_price,
  price_currency as entry_currency, total as score_total, {joined('reasons')} as reasons, {joined('warnings')} as warnings,
  '../reports/' || strategy || '/2024-02-01.html' as report_url, case when strategy = 'long-term' then bucket end as bucket,
  case when strategy = 'long-term' then tier end as tier, case when strategy = 'long-term' then len(anchors)::double end as anchors,
  case when strategy = 'long-term' then {growth} end as growth_view
from (select *, row_number() over (partition by strategy order by case when strategy = 'long-term' then {TIER_ORDER} else 0 end, total desc, ticker, ordinal) as rank from ideas)
where rank <= 20""")


_register()
