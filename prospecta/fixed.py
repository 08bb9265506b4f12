"""Values that results depend on, as data: forms, deny list, filers, groups, theme terms, statuses."""

from __future__ import annotations

# Filing forms and their classes.
FORMS = ("S-1", "N-1A", "485BPOS", "485APOS")
INITIAL_FORMS = ("S-1", "N-1A")
AMENDMENT_FORMS = ("485APOS", "485BPOS")
LAUNCH_FORMS = ("S-1", "N-1A", "485APOS")
DAYS_BACK, LOOKAHEAD_DAYS, OVERLAP_DAYS, BACKFILL_DAYS = 60, 90, 3, 365
SERIES_NEW_MONTHS, RECENT_DAYS = 18, 30
PARSER_VERSION, STORE_VERSION = 15, 1
INDEX_CHARS = IDENTITY_CHARS = 300_000
SCAN_CHARS, WINDOW_FALLBACK_CHARS, WINDOW_BEFORE, WINDOW_AFTER = 1_000_000, 120_000, 2_000, 8_000
ANCHOR, FALLBACK_ANCHOR = "it is proposed that this filing will become effective", "pursuant to paragraph"

# Words that are no ticker.
DENIED_TICKERS = (
    "AND", "ARCA", "BATS", "CBOE", "CIK", "DATE", "EACH", "EDGX", "ETF", "EXCH", "FREE", "FUND", "LONG", "MID", "NAME",
    "NONE", "SEI", "THE", "THIS",
)
# Exchange names before a fund's name.
EXCHANGE_PREFIXES = ("BZX", "NYSE", "NASDAQ", "CBOE", "ARCA")

# Vehicles, ticker sources and statuses.
ETF, MUTUAL_FUND, UNKNOWN = "ETF", "Mutual fund share class", "Other / unknown"
FROM_MAP, FROM_FILING, FROM_LATER, FROM_NONE = "sec_fund_ticker_map", "filing", "later_filing_fallback", "not_listed"
INITIAL_REVIEW, UPCOMING, RECENT, STALE = "Initial review", "Upcoming launch", "Recently launched", "Launched (stale)"
EXISTING, ROUTINE = "Existing fund amendment", "Routine 485(b) update"
EFFECTIVE, UNDETECTED = "Effective (amendment)", "Timing undetected"
VISIBLE_STATUSES = (INITIAL_REVIEW, UPCOMING)
HIDDEN_STATUSES = (RECENT, STALE, EXISTING, ROUTINE, EFFECTIVE, UNDETECTED)

# Filers by number, in order.
FILERS = (
    ("0001496608", "AB Active ETFs, Inc."), ("0000804239", "American Century Mutual Funds, Inc."), ("0000051931", "American Funds Insurance Series"),
    ("0001633061", "Amplify ETF Trust"), ("0001579982", "ARK ETF Trust"), ("0001761055", "BlackRock ETF Trust"), ("0001804196", "BlackRock ETF Trust II"),
    ("0001424958", "Direxion Shares ETF Trust"), ("0001592900", "EA Series Trust"), ("0001771146", "ETF Opportunities Trust"), ("0001540305", "ETF Series Solutions"),
    ("0001452937", "Exchange Traded Concepts Trust"), ("0000819118", "Fidelity Concord Street Trust"), ("0000915802", "Financial Investors Trust"),
    ("0001655589", "Franklin Templeton ETF Trust"), ("0001090372", "First Trust Exchange-Traded Fund"), ("0001432353", "Global X Funds"),
    ("0001479026", "Goldman Sachs ETF Trust"), ("0001725210", "Grayscale Ethereum Staking ETF"), ("0001318342", "Investment Managers Series Trust"),
    ("0001587982", "Investment Managers Series Trust II"), ("0001337567", "iShares Gold Trust"), ("0001100663", "iShares Trust"), ("0001500604", "Janus Detroit Street Trust"),
    ("0001485894", "J.P. Morgan Exchange-Traded Fund Trust"), ("0001676326", "Morgan Stanley ETF Trust"), ("0001969995", "Nomura ETF Trust"),
    ("0000809064", "Nomura ETF Trust II"), ("0001881741", "NEOS ETF Trust"), ("0001491978", "FlexShares Trust"), ("0001644419", "Northern Lights Fund Trust IV"),
    ("0000916620", "Northern Funds"), ("0001635073", "NuShares ETF Trust"), ("0001450011", "PIMCO ETF Trust"), ("0001174610", "ProShares Trust"),
    ("0001454889", "Schwab Strategic Trust"), ("0001888997", "SEI Exchange Traded Funds"), ("0001064641", "Select Sector SPDR Trust"),
    ("0001400683", "SPDR ICE Preferred Securities ETF Trust"), ("0001064642", "SPDR Series Trust"), ("0001742912", "Tidal ETF Trust"), ("0001924868", "Tidal Trust II"),
    ("0001137360", "VanEck ETF Trust"), ("0000036405", "Vanguard Index Funds"), ("0001350487", "WisdomTree Trust"),
)
# Filers shown under one label.
TIDAL_FILERS, TIDAL_NAME, TIDAL_LABEL = ("0001742912", "0001924868"), "TIDAL TRUST", "TIDAL"

# Group rules in order; `^` marks a prefix, others are found anywhere in the lower-cased name.
GROUP_RULES = (
    ("AllianceBernstein", ("alliancebernstein", "ab active etfs")), ("BlackRock", ("blackrock", "ishares")), ("Vanguard", ("vanguard",)),
    ("SPDR", ("spdr", "state street", "ssga")), ("WisdomTree", ("wisdomtree",)), ("Invesco", ("invesco", "db commodity index tracking fund")),
    ("Direxion", ("direxion",)), ("Schwab", ("schwab",)), ("JPMorgan", ("jpmorgan", "j.p. morgan exchange-traded fund trust")),
    ("Morgan Stanley", ("morgan stanley",)), ("Nomura", ("nomura",)), ("SEI", ("sei exchange traded funds",)),
    ("Investment Managers Series Trust", ("investment managers series trust",)), ("First Trust", ("first trust",)), ("VanEck", ("vaneck",)),
    ("Fidelity", ("fidelity",)), ("Capital Group / American Funds", ("american funds", "capital group")), ("American Century", ("american century",)),
    ("ProShares", ("proshares", "profunds")), ("PIMCO", ("pimco",)), ("Global X", ("global x",)), ("Goldman Sachs", ("goldman sachs",)),
    ("Franklin Templeton", ("franklin",)), ("Janus Henderson", ("janus henderson", "^janus ", "janus detroit street trust")), ("Pacer", ("pacer",)),
    ("Innovator", ("innovator",)), ("PGIM", ("pgim",)), ("Financial Investors Trust", ("financial investors trust",)),
    ("Exchange Traded Concepts Trust", ("exchange traded concepts trust",)),
    ("ETF Architect", ("ea series trust", "alpha architect", "etf architect", "empowered funds")), ("NEOS", ("neos",)), ("VictoryShares", ("victoryshares",)),
    ("ALPS", ("^alps",)), ("Amplify", ("amplify",)), ("Grayscale", ("grayscale",)), ("Nuveen", ("nuveen", "nushares")), ("ARK", ("^ark ",)),
    ("Northern Trust Asset Management", ("flexshares trust", "northern funds", "northern trust")), ("Northern Lights", ("northern lights",)),
    ("Simplify", ("simplify",)), ("John Hancock", ("john hancock",)), ("Eaton Vance", ("eaton vance",)), ("ETF Series Solutions", ("etf series solutions",)),
    ("BMO", ("^bmo",)), ("Columbia", ("columbia",)), ("Principal", ("principal",)), ("TIDAL", ("tidal",)), ("F/m", ("^f/m",)),
    ("ETF Opportunities Trust", ("etf opportunities", "opportunities trust")), ("Defiance", ("defiance",)), ("BondBloxx", ("bondbloxx",)),
)
TOP_GROUPS = ("BlackRock", "SPDR", "Vanguard")
SERIES_TRUST_GROUPS = (
    "EA Series Trust", "ETF Architect", "ETF Opportunities Trust", "ETF Series Solutions", "Exchange Traded Concepts Trust",
    "Financial Investors Trust", "Investment Managers Series Trust", "Northern Lights", "TIDAL",
)

# Themes in the order of display.
LEVERAGED, CRYPTO, OPTIONS, BONDS = "Leveraged / Inverse", "Crypto / Digital Assets", "Options Income / Covered Call", "Fixed Income / Credit"
COMMODITIES, INTERNATIONAL = "Commodities / Gold / Energy", "International / Emerging Markets"
DIVIDEND, MATURITY, FACTOR, THEMATIC, OTHER = "Dividend / Income", "Target Maturity", "Factor / Quant / Active", "Thematic Equity", "Other"
THEMES = (LEVERAGED, CRYPTO, OPTIONS, BONDS, COMMODITIES, INTERNATIONAL, DIVIDEND, MATURITY, FACTOR, THEMATIC, OTHER)
# Theme terms, in the order of precedence after leveraged and inverse names.
THEME_TERMS = (
    (CRYPTO, ("bitcoin", "blockchain", "cardano", "crypto", "cryptocurrency", "digital asset", "dogecoin", "btc", "ether", "eth", "ethereum", "litecoin", "solana", "xrp")),
    (OPTIONS, ("buffer", "buywrite", "covered call", "defined outcome", "downside protection", "income premium", "option income", "options income", "premium income", "putwrite", "tail risk")),
    (MATURITY, ("target maturity", "defined maturity", "ibonds", "ladder", "maturity bond")),
    (BONDS, ("aggregate bond", "bank loan", "bond", "core plus", "credit", "debt", "duration", "fixed income", "high yield", "income opportunities", "loan", "mortgage", "municipal", "muni", "securitized", "treasury", "ultrashort bond")),
    (COMMODITIES, ("agriculture", "commodity", "copper", "energy", "gold", "metals", "natural gas", "oil", "silver", "uranium")),
    (INTERNATIONAL, ("asia", "china", "developed ex us", "emerging market", "emerging markets", "europe", "ex us", "frontier", "global ex us", "international", "japan", "latin america")),
    (DIVIDEND, ("dividend", "equity income", "free cash flow", "high income", "shareholder yield", "yield")),
    (FACTOR, ("active", "alpha", "dynamic", "equal weight", "factor", "fundamental", "low volatility", "momentum", "quality", "quant", "value")),
    (THEMATIC, ("ai", "artificial intelligence", "biotech", "cybersecurity", "data center", "defense", "disruptive", "electric vehicle", "fintech", "infrastructure", "innovation", "nuclear", "robotics", "semiconductor", "space", "technology")),
)
# Leveraged and inverse names.
GEARED_WORDS = ("leveraged", "inverse", "ultra", "ultrapro", "quadpro", "ultrashort", "geared", "bull", "bear")
SHORT_FOLLOWERS = ("duration", "term", "maturity", "bond", "credit", "income", "municipal", "muni", "treasury")
