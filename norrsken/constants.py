"""Texts, codes, thresholds and rates that must equal the published behaviour."""

# --- fixed values: strategies, horizons, codes -------------------------------------------
STRATEGIES = ("balanced", "long-term", "trading", "momentum", "discovery")
TRACKED_STRATEGIES = ("trading", "long-term")
HORIZONS = {"1d": 1, "5d": 5, "20d": 20, "60d": 60}
LEDGER_SCHEMA_VERSION = 1
SEGMENTS = ("main_market", "first_north", "spotlight", "other_public")
DATA_QUALITIES = ("good", "partial", "thin")
LISTING_COUNTRIES = ("SE", "FI")
EUR_RATES = {"EUR": 1.0, "SEK": 0.1}
SYMBOL_SUFFIXES = {"SE": ".ST", "FI": ".HE"}
DISCLAIMER = "Research triage only. Not financial advice."

# --- fixed values: market signal texts ---------------------------------------------------
LIVE_PRICE = "Live price available from Nasdaq Nordic"
STRONG_MOMENTUM = "Strong intraday momentum"
POSITIVE_MOMENTUM = "Positive intraday momentum"
HIGH_TURNOVER = "High live turnover"
MODERATE_TURNOVER = "Moderate live turnover"
SPARSE_DATA = "Sparse live-source data"
EXTREME_SPIKE = "Extreme intraday spike"
SHARP_SELLOFF = "Sharp intraday selloff"
LOW_PRICE = "Speculative low-price share"
LOW_TURNOVER = "Low live turnover"
MISSING_TURNOVER = "Missing live turnover"
TRADING_ONLY_SIGNALS = (LIVE_PRICE, HIGH_TURNOVER, MODERATE_TURNOVER)
EVENT_TERMS = (
    "announced", "contract", "customer", "earnings", "guidance", "launch", "order",
    "partnership", "release", "report", "result", "tender", "win",
)

# --- fixed values: company-name words that do not identify a company ---------------------
NAME_SUFFIXES = (
    "ab", "ag", "corp", "corporation", "inc", "limited", "ltd", "oy", "oyj", "plc", "publ",
    "a", "b",
)

# --- fixed values: quality buckets and gate tiers ----------------------------------------
BUCKET_QUALITY = "Quality small-cap candidate"
BUCKET_WATCHLIST = "Fundamental watchlist candidate"
BUCKET_SPECULATIVE = "Speculative small-cap monitor"
BUCKET_INSUFFICIENT = "Insufficient evidence"
TIER_HIGH = "High-conviction candidate"
TIER_WATCHLIST = "Fundamental watchlist"
TIER_SPECULATIVE = "Speculative monitor"
TIER_INSUFFICIENT = "Insufficient evidence"
TIERS = (TIER_HIGH, TIER_WATCHLIST, TIER_SPECULATIVE, TIER_INSUFFICIENT)
SEVERE_GAPS = (
    "No profitability signal",
    "Negative operating margin",
    "High debt/equity",
    "Thin data quality",
    "Missing business description",
    "Missing liquidity data",
)
PROOF_GAPS = (
    "high debt/equity",
    "missing business description",
    "missing liquidity data",
    "missing valuation data",
    "negative operating margin",
    "no growth signal",
    "no profitability signal",
    "only live-market support",
    "thin data quality",
    "thin liquidity",
)

# --- fixed values: outcome states --------------------------------------------------------
NOT_DUE = "not_due"
PRICED = "priced"
MISSING_PRICE = "missing_price"
MISSED_WINDOW = "missed_window"

# --- fixed values: market names ----------------------------------------------------------
MARKET_ALIASES = {
    "stockholm": "stockholm",
    "sto": "stockholm",
    "se": "stockholm",
    "sweden": "stockholm",
    "nasdaq-stockholm": "stockholm",
    "nasdaq stockholm": "stockholm",
    "helsinki": "helsinki",
    "hel": "helsinki",
    "fi": "helsinki",
    "finland": "helsinki",
    "nasdaq-helsinki": "helsinki",
    "nasdaq helsinki": "helsinki",
}
