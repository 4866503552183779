"""Fixed values of the result vocabulary: labels, horizons, thresholds, metric names.

Everything in this file is a value that results must carry literally.  It holds
no logic.
"""

from types import SimpleNamespace as Names

NA = "n/a"

# ---- fixed values: horizons and windows, in trading sessions -------------------
FORWARD_HORIZONS = (1, 2, 3, 5, 7, 20)
EXCURSION_HORIZONS = (3, 5, 7)
TRAILING_HORIZONS = (5, 20)
CLOSE_AVERAGES = (20, 50)
PERFORMANCE_WINDOWS = (
    ("1 day", 1),
    ("5 days", 5),
    ("1 month (21 trading days)", 21),
    ("3 months (63 trading days)", 63),
    ("6 months (126 trading days)", 126),
    ("1 year (252 trading days)", 252),
)
YEAR_TO_DATE = "Year to date"
FULL_PERIOD = "Full period"
LEAST_RETURN_STD = 1e-12
LEAST_RELATIVE_VOLUME_STD = 1e-9
LONGEST_NORMAL_GAP_DAYS = 6
STALE_AFTER_DAYS = 7
OHLC_TOLERANCE = 0.001
TICKER_PATTERN = r"^[A-Z0-9^][A-Z0-9.\-=^]{0,14}$"

# ---- fixed values: input column names ------------------------------------------
BAR_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")
COLUMN_ALIASES = {
    "date": ("date", "datetime", "timestamp"),
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close", "close/last"),
    "adj_close": ("adj close", "adj_close", "adjclose", "adjusted close"),
    "volume": ("volume",),
}

# ---- fixed values: events --------------------------------------------------------
PRICE_RULES = ("return_zscore", "abs_return")
VOLUME_RULES = ("volume_ratio", "volume_zscore")
ANOMALY = Names(
    both="Abnormal price move with abnormal volume",
    price="Abnormal price move (volume not flagged)",
    volume="Abnormal volume (price move not flagged)",
)
UNKNOWN_CATEGORY = "Unknown"
UNVERIFIED = "Unverified"
EARNINGS_CATEGORY = "Earnings release (date match)"
DATE_MATCHED = "Unverified (automatic date match)"
RESEARCHED = "Researched manually"
MARKET_CLOSE_HOUR = 16
PRICE_OUTCOMES = tuple(
    [f"fwd_return_{h}d" for h in FORWARD_HORIZONS]
    + [f"mfe_{h}d" for h in EXCURSION_HORIZONS]
    + [f"mae_{h}d" for h in EXCURSION_HORIZONS]
)
ABNORMAL_OUTCOMES = tuple(f"fwd_abnormal_{h}d" for h in FORWARD_HORIZONS)
OUTCOMES = (
    *(f"fwd_return_{h}d" for h in FORWARD_HORIZONS),
    *ABNORMAL_OUTCOMES,
    *(f"mfe_{h}d" for h in EXCURSION_HORIZONS),
    *(f"mae_{h}d" for h in EXCURSION_HORIZONS),
)
RESEARCH_FIELDS = (
    "event_category",
    "event_description",
    "source",
    "verification_status",
    "notes",
)
EVENT_COLUMNS = (
    "ticker",
    "event_date",
    "close",
    "daily_return",
    "return_zscore",
    "volume",
    "avg_volume",
    "volume_ratio",
    "volume_zscore",
    "benchmark",
    "benchmark_return",
    "abnormal_return",
    *OUTCOMES,
    "direction",
    "is_price_event",
    "is_volume_event",
    "trigger_rules",
    "anomaly_type",
    "trading_days_since_prev_event",
    *RESEARCH_FIELDS,
)
BASELINE_GROUP = "All trading days (baseline)"

# ---- fixed values: swing labels ---------------------------------------------------
TREND = Names(
    strong_up="Strong short-term uptrend",
    up="Short-term uptrend",
    improving="Improving",
    mixed="Mixed",
    deteriorating="Deteriorating",
    down="Short-term downtrend",
    strong_down="Strong short-term downtrend",
)
EMA50 = Names(up="Price above rising EMA50", down="Price below falling EMA50", mixed="Mixed")
RSI_ZONES = (
    (80, "Extremely strong / extended"),
    (70, "Strong momentum"),
    (60, "Positive momentum"),
    (50, "Mild positive momentum"),
    (40, "Mild negative momentum"),
    (30, "Weak momentum"),
)
RSI_LOWEST = "Oversold"
MACD = Names(improving="Improving", weakening="Weakening", positive="Positive", negative="Negative")
MOMENTUM = Names(
    strong_positive="Strong positive",
    positive="Positive",
    mixed="Mixed",
    negative="Negative",
    strong_negative="Strong negative",
)
VOLUME_LEVELS = (
    (2.0, "Very high participation"),
    (1.5, "Strong participation"),
    (0.8, "Normal"),
)
VOLUME_LOWEST = "Weak participation"
BAND = Names(
    above="Above upper band",
    near_upper="Near upper band",
    upper_half="Between middle and upper band",
    middle="Near middle band",
    lower_half="Between middle and lower band",
    near_lower="Near lower band",
    below="Below lower band",
)
WIDTH = Names(
    after_squeeze="Expansion after squeeze",
    expansion="Band expansion",
    squeeze="Volatility squeeze",
    contraction="Band contraction",
    stable="Stable",
)
CONTEXT = Names(
    upper_walk="Upper-band walk (strong momentum)",
    upper_push="Close above the upper band with trend and volume",
    upper_extension="Extension above the upper band without trend / volume confirmation",
    lower_walk="Lower-band walk (strong downside momentum)",
    lower_push="Close below the lower band with trend and volume",
    lower_extension="Drop below the lower band without trend / volume confirmation",
    none="None",
)
VOLATILITY_LEVELS = ((95, "Extreme"), (80, "High"), (60, "Elevated"), (20, "Normal"))
VOLATILITY_LOWEST = "Low"
STRENGTH = Names(
    strong_out="Strongly outperforming",
    out="Outperforming",
    neutral="Neutral",
    under="Underperforming",
    strong_under="Strongly underperforming",
)
ADX = Names(
    trending="Trending environment",
    weak="Weak / range-bound environment",
    borderline="Borderline (ADX 20-25)",
)
CONDITION = Names(
    strong="Strong", improving="Improving", mixed="Mixed", weakening="Weakening", weak="Weak"
)

# ---- fixed values: structure states in priority order ----------------------------
STATES = {
    "breakout_volume": "Breakout with volume confirmation",
    "breakout_normal": "Breakout on normal volume",
    "breakout_weak": "Breakout without volume confirmation",
    "breakdown_volume": "Short-term breakdown with heavy volume",
    "breakdown": "Short-term breakdown",
    "losing_ema21": "Price losing EMA21",
    "reclaiming_ema21": "Price reclaiming EMA21",
    "ema_cross_down": "EMA9 crossed below EMA21",
    "ema_cross_up": "EMA9 crossed above EMA21",
    "pullback_ema9": "Pullback to EMA9",
    "pullback_ema21": "Pullback to EMA21",
    "pullback": "Pullback within swing uptrend",
    "losing_ema9": "Price losing EMA9",
    "reclaiming_ema9": "Price reclaiming EMA9",
    "near_breakout": "Near breakout",
    "momentum_deterioration": "Momentum deterioration",
    "ema_compression": "EMA9 / EMA21 compression",
    "volatility_squeeze": "Volatility squeeze",
    "range": "Range / consolidation",
    "bull_stack": "Price > EMA9 > EMA21",
    "bear_stack": "Price < EMA9 < EMA21",
}
NO_STRUCTURE = "No distinct structure"

# ---- fixed values: points of the swing score -----------------------------------
TREND_POINTS = {
    TREND.strong_up: 3,
    TREND.up: 2,
    TREND.improving: 1,
    TREND.mixed: 0,
    TREND.deteriorating: -1,
    TREND.down: -2,
    TREND.strong_down: -3,
}
MACD_POINTS = {MACD.improving: 1, MACD.positive: 0, MACD.negative: 0, MACD.weakening: -1}
STRENGTH_POINTS = {
    STRENGTH.strong_out: 1,
    STRENGTH.out: 1,
    STRENGTH.neutral: 0,
    STRENGTH.under: -1,
    STRENGTH.strong_under: -1,
}
CONTEXT_POINTS = {CONTEXT.upper_walk: 1, CONTEXT.lower_walk: -1}
EMA50_POINTS = {EMA50.up: 1, EMA50.down: -1}
STRUCTURE_POINTS = {
    STATES["breakout_volume"]: 2,
    STATES["breakout_normal"]: 1,
    STATES["reclaiming_ema21"]: 1,
    STATES["ema_cross_up"]: 1,
    STATES["breakdown_volume"]: -2,
    STATES["breakdown"]: -1,
    STATES["losing_ema21"]: -1,
    STATES["ema_cross_down"]: -1,
    STATES["momentum_deterioration"]: -1,
}

# ---- fixed values: fundamentals ----------------------------------------------------
# (metric, key of the company-info map, unit type, label)
SNAPSHOT_METRICS = (
    ("market_cap", "marketCap", "money_trading", "Market capitalization"),
    ("enterprise_value", "enterpriseValue", "money_trading", "Enterprise value"),
    ("revenue_ttm", "totalRevenue", "money_financial", "Revenue (trailing 12 months)"),
    ("revenue_growth_yoy_quarterly", "revenueGrowth", "ratio",
     "Revenue growth (latest quarter vs. same quarter a year earlier)"),
    ("gross_margin_ttm", "grossMargins", "ratio", "Gross margin (trailing 12 months)"),
    ("operating_margin", "operatingMargins", "ratio", "Operating margin (as reported)"),
    ("net_income_ttm", "netIncomeToCommon", "money_financial",
     "Net income to common (trailing 12 months)"),
    ("eps_ttm", "trailingEps", "per_share", "EPS (trailing 12 months)"),
    ("free_cash_flow_ttm", "freeCashflow", "money_financial",
     "Free cash flow (levered, trailing 12 months)"),
    ("ebitda_ttm", "ebitda", "money_financial", "EBITDA (trailing 12 months)"),
    ("total_cash", "totalCash", "money_financial",
     "Cash and short-term investments (latest quarter)"),
    ("total_debt", "totalDebt", "money_financial", "Total debt (latest quarter)"),
    ("shares_outstanding", "sharesOutstanding", "shares", "Shares outstanding"),
    ("pe_trailing", "trailingPE", "ratio", "P/E (trailing)"),
    ("pe_forward", "forwardPE", "ratio", "P/E (forward, based on analyst estimates)"),
    ("ev_to_sales", "enterpriseToRevenue", "ratio", "EV / Sales"),
    ("ev_to_ebitda", "enterpriseToEbitda", "ratio", "EV / EBITDA"),
)
# (metric, statement, line items in order of preference, unit type, label)
STATEMENT_METRICS = (
    ("revenue", "income", ("TotalRevenue",), "money_financial", "Revenue"),
    ("gross_profit", "income", ("GrossProfit",), "money_financial", "Gross profit"),
    ("operating_income", "income", ("OperatingIncome", "TotalOperatingIncomeAsReported"),
     "money_financial", "Operating income"),
    ("net_income", "income", ("NetIncomeCommonStockholders", "NetIncome"),
     "money_financial", "Net income"),
    ("eps_diluted", "income", ("DilutedEPS",), "per_share", "Diluted EPS"),
    ("ebitda", "income", ("EBITDA",), "money_financial", "EBITDA"),
    ("operating_cash_flow", "cashflow", ("OperatingCashFlow",), "money_financial",
     "Operating cash flow"),
    ("capital_expenditure", "cashflow", ("CapitalExpenditure",), "money_financial",
     "Capital expenditure"),
    ("free_cash_flow", "cashflow", ("FreeCashFlow",), "money_financial", "Free cash flow"),
    ("cash_and_equivalents", "balance", ("CashAndCashEquivalents",), "money_financial",
     "Cash and cash equivalents"),
    ("total_debt", "balance", ("TotalDebt",), "money_financial", "Total debt"),
    ("shares_outstanding", "balance", ("OrdinarySharesNumber", "ShareIssued"), "shares",
     "Shares outstanding"),
)
# (metric, unit type, label)
CALCULATED_METRICS = (
    ("revenue_growth", "ratio", "Revenue growth vs. previous fiscal year (calculated)"),
    ("gross_margin", "ratio", "Gross margin = gross profit / revenue (calculated)"),
    ("operating_margin", "ratio", "Operating margin = operating income / revenue (calculated)"),
    ("net_margin", "ratio", "Net margin = net income / revenue (calculated)"),
)
PROFILE_KEYS = {
    "name": ("longName", "shortName"),
    "exchange": ("fullExchangeName", "exchange"),
    "sector": ("sector",),
    "industry": ("industry",),
    "currency": ("currency",),
    "financial_currency": ("financialCurrency",),
    "country": ("country",),
    "quote_type": ("quoteType",),
}
STOCK_FIELDS = ("name", "exchange", "sector", "industry", "currency", "country", "quote_type")
FUNDAMENTAL_COLUMNS = (
    "ticker", "period_type", "period_end", "metric", "label", "value", "unit", "source",
    "retrieved_at",
)
CURRENCY_UNKNOWN = "currency unknown"

# Labels of event groups, by side of the price rule and by volume rule (None: either).
EVENT_GROUPS = {
    (None, None): "All events",
    ("up", None): "Up moves (price rule fired)",
    ("down", None): "Down moves (price rule fired)",
    ("up", True): "Up moves with abnormal volume",
    ("up", False): "Up moves without abnormal volume",
    ("down", True): "Down moves with abnormal volume",
    ("down", False): "Down moves without abnormal volume",
}
VOLUME_ONLY = "Volume-only events"
