"""Fixed values. Results depend on every entry and on the order of lookups; change nothing."""

from __future__ import annotations

# Class index order: 0, 1, 2.
SENTIMENTS = ("positive", "negative", "neutral")
IMPACTS = ("high", "medium", "low", "unknown")

# White space as Python's str.split() and str.strip() see it.
WHITESPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# Fixed word list: hedging.
HEDGE_WORDS = (
    "may", "might", "could", "would", "should", "possibly", "potentially", "likely",
    "unlikely", "uncertain", "expects", "anticipates", "believes", "estimates",
    "approximately", "about", "around", "roughly", "seems", "appears",
)

# Fixed word list: negation.
NEGATION_WORDS = (
    "not", "no", "never", "neither", "nor", "hardly", "barely", "scarcely", "failed",
    "fails", "miss", "missed", "despite", "however", "but", "without",
)

# Fixed pattern: forward-looking statements, between word boundaries, any case.
FORWARD_LOOKING_TERMS = (
    r"will|shall|forecast|guidance|outlook|project(?:s|ed)|plan(?:s|ned)|expect(?:s|ed)"
    r"|next{ws}+(?:quarter|year|month|fiscal)|fiscal{ws}+20\p{Nd}{2}|full[{ws_in}-]year"
)

# Fixed lookup: ticker to sector.
TICKER_SECTORS = {
    "AAPL": "Technology", "MSFT": "Technology", "GOOGL": "Technology", "META": "Technology",
    "NVDA": "Technology", "AMD": "Technology", "INTC": "Technology", "TSM": "Technology",
    "JPM": "Financials", "BAC": "Financials", "GS": "Financials", "MS": "Financials",
    "WFC": "Financials", "V": "Financials", "MA": "Financials",
    "XOM": "Energy", "CVX": "Energy", "COP": "Energy", "SLB": "Energy",
    "JNJ": "Healthcare", "UNH": "Healthcare", "PFE": "Healthcare", "ABBV": "Healthcare",
    "AMZN": "Consumer Discretionary", "TSLA": "Consumer Discretionary",
    "NKE": "Consumer Discretionary",
    "WMT": "Consumer Staples", "PG": "Consumer Staples", "KO": "Consumer Staples",
    "BTC": "Crypto", "ETH": "Crypto",
}

# Fixed word list: capitals that are not tickers.
TICKER_BLOCKLIST = (
    "I", "A", "AT", "BE", "BY", "FOR", "IT", "IN", "IS", "OR", "ON", "OF", "TO", "US", "ARE",
    "CEO", "CFO", "IPO", "ETF", "GDP", "FED", "SEC", "FTC", "FDA", "AI", "ML", "CAGR", "YOY",
    "QOQ", "EPS", "PE", "EV", "EBIT", "EBITDA", "Q1", "Q2", "Q3", "Q4",
)

# Fixed word lists: market impact, matched as substrings of the lower-cased headline.
HIGH_IMPACT = (
    "crash", "collapse", "surge", "plunge", "recession", "fed rate", "bankruptcy", "default",
    "rate hike", "rate cut", "layoffs", "merger", "acquisition", "earnings beat",
    "earnings miss", "profit warning", "upgrade", "downgrade", "investigation", "fraud",
    "scandal", "sanction",
)
MEDIUM_IMPACT = (
    "report", "quarterly", "revenue", "profit", "loss", "guidance", "analyst", "forecast",
    "dividend", "buyback",
)

# Fixed histogram bounds, seconds.
E2E_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
PRODUCE_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
