"""What a filing document says of a fund: its name, ticker, name-ticker pairs, registrant and exchange listing.

Names and tickers are read by ordered rules; a rule that does not match, or whose value is refused, gives way to the next.
Each document is cleaned and walked once, in a UDF over Arrow batches; only the short answers leave it.

Defined results: a null or blank document has no name ("N/A"), no ticker, no pairs and no registrant and is not listed. An
error in one document is returned in `error` and never fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prospecta import fixed
from prospecta.sources.parse import DATA, EFFECTIVENESS, ENTRIES, START, clean, election_or_blank, name_and_ticker, rows_of, series_entries, walk

NO_NAME = "N/A"

# The patterns that names, tickers, pairs, registrants and listings are read by, each list in its order.
SHORT = r"[A-Za-z0-9&\-\.\s]{3,120}?(?:ETF|Fund)"


def long_name(most: int) -> str:
    """A name of a capital and at most so many characters before its last word."""
    return rf"[A-Z][A-Za-z0-9&\-\.\(\)/,\s]{{3,{most}}}?(?:ETF|Fund)"


LONG, LONG_160, LONG_140, LONG_120 = map(long_name, (180, 160, 140, 120))
ANY = r"[A-Z][A-Za-z0-9&\-\.\(\)/,\s]{3,180}?"
TICKER = r"(?P<ticker>[A-Z]{3,4})"
STATUS = r"(?:new|existing|active|inactive)"
ADDRESS = r"Mailing\s+Address|Business\s+Address|$"
ENTRY_END = rf"(?=\s+(?:Status\s+Name\s+Ticker\s+Symbol|{ADDRESS}))"
EXCHANGE_WORDS = r"(?:NYSE|NASDAQ|CBOE|Cboe|ARCA|Arca|BZX|Exchange|Stock\s+Exchange)"

NAME_PATTERNS = (
    rf"\[\s*[A-Z]{{1,8}}\s*\]\s*\|\s*(?P<name>{SHORT})",
    rf"(?P<name>{LONG})\s*\|\s*[A-Z]{{1,8}}\s*\|",
    rf"[A-Z]{{2,6}}\s*\|\s*(?P<name>{SHORT})",
    rf"\b[A-Z]{{2,8}}\s+{LONG_120}\s+(?P<name>{LONG})\s+is\s+listed\s+on\b",
    rf"\b(?P<name>{LONG})\s+is\s+listed\s+on\b",
    rf"Series\s+S\d+\s+(?P<name>{LONG})\s+Class/Contract",
)
NAME_OF_CLASS = rf"Series\s+S\d+\s+{STATUS}?\s*{ANY}\s+Class/Contract\s+C\d+\s+(?P<name>{ANY})(?=\s+(?:{ADDRESS}))"
NAME_MARKUP = (
    r'<td[^>]*class="seriesName"[^>]*>.*?</td>\s*<td[^>]*class="seriesCell"[^>]*>.*?</td>\s*<td[^>]*class="seriesCell"[^>]*>(?P<name>.*?)</td>',
    r'<tr[^>]*class="contractRow"[^>]*>.*?<td[^>]*>.*?</td>\s*<td[^>]*>.*?</td>\s*<td[^>]*>(?P<name>.*?)</td>\s*</tr>',
    r"<oef:RiskReturnHeading[^>]*>(?P<name>.*?)</oef:RiskReturnHeading>",
)
SERIES_CELL = "seriesCell"
NAME_LAST = r"(?P<name>[A-Z][A-Za-z0-9&\s\-]{5,100}(?:ETF|Fund))"

TICKER_BRACKETED = rf"\[\s*{TICKER}\s*\]\s*\|\s*{SHORT}"
TICKER_ROW, TICKER_CELL = r'<tr[^>]*class="contractRow"[^>]*>(.*?)</tr>', r"<td[^>]*>(.*?)</td>"
TICKER_LISTED = (
    rf"\b{TICKER}\s+(?P<name>{LONG_120})\s+ProShares\s+(?P=name)\s+is\s+listed\s+on\b",
    rf"\b{TICKER}\s+(?P<name>ProShares\s+{LONG_160})\s+(?P=name)\s+is\s+listed\s+on\b",
    r'\bunder\s+the\s+ticker\s+symbol\s+"(?P<ticker>[A-Z]{3,4})\.?"',
    rf"{LONG}\s*\|\s*{TICKER}\s*\|",
)
TICKER_LABEL, LABEL_CHARS = rf"Ticker Symbol\s*:?\s*{TICKER}\b", 2000
TICKER_LAST = (
    rf"Fund\s+Ticker\s+Principal U\.S\. Listing Exchange.*?(?:ETF|Fund)\s+{TICKER}\b",
    rf"{TICKER}\s*\|\s*{SHORT}",
    rf"Ticker Symbol\s+{TICKER}",
    rf"Class/Contract\s+C\d+\s+{LONG}\s+{TICKER}{ENTRY_END}",
)

PAIR_HEADING = r"Fund\s+Name\s+Ticker\s+Symbol\s+Exchange\s+"
PAIR_PATTERNS = (
    rf"(?P<name>{LONG})\s*\(\s*{TICKER}\s*\)",
    rf"(?:{PAIR_HEADING})?(?P<name>{LONG})\s+{TICKER}\s+{EXCHANGE_WORDS}",
    rf"\[\s*{TICKER}\s*\]\s*\|\s*(?P<name>{LONG})",
    rf"\b{TICKER}\s+{LONG_120}\s+(?P<name>ProShares\s+{LONG_160})\s+is\s+listed\s+on\b",
    rf"\b{TICKER}\s+(?P<name>ProShares\s+{LONG_160})(?=\s+[A-Z]{{3,4}}\s+ProShares|\s+Each Fund is listed on|\s+Each ETF is listed on|\s+is listed on\b)",
    rf"(?P<name>{LONG})\s*\|\s*{TICKER}\s*\|\s*(?:NYSE|NASDAQ|CBOE|BZX|ARCA|STOCK\s+EXCHANGE)",
    rf"Series\s+S\d+\s+{LONG}\s+Class/Contract\s+C\d+\s+(?P<name>{LONG})\s+{TICKER}",
)
PAIR_LINES = (rf"{TICKER}\s+(?P<name>{LONG_140})", rf"(?P<name>{LONG_140})\s*\(\s*{TICKER}\s*\)")

REGISTRANT_SPAN = r'<span class="companyName">(?P<name>.*?)\s*\(Filer\)'
REGISTRANT_MARK, REGISTRANT_LINES = "Exact Name of Registrant as Specified in Charter", 5
REGISTRANT_CHARS, REGISTRANT_AFTER = r"[A-Za-z0-9&,\.\-\s]+", rf"\({REGISTRANT_MARK}\)"

SHARES = r"(?:fund(?:['’]s)?\s+shares|shares\s+of\s+the\s+fund)"
EXCHANGE = r"(?:NYSE(?:\s+Arca)?|Cboe(?:\s+BZX)?|Nasdaq|BZX|national securities exchange|[A-Z][A-Za-z&.\- ]{0,40}\s+Exchange)"
LISTED = (
    r"\bas with all exchange[- ]traded funds\b",
    r"\b(?:the\s+)?fund\s+is\s+an?\s+exchange[- ]traded fund\b",
    rf"\b{SHARES}\b.{{0,140}}\b(?:listed(?:\s+and\s+traded)?|traded)\b.{{0,80}}\b(?:on|upon)\s+(?:the\s+)?{EXCHANGE}\b",
)
AT_MARKET_PRICES = rf"\b{SHARES}\b.{{0,180}}\b(?:trade|traded|bought\s+and\s+sold)\b.{{0,120}}\bat market prices\b"
AROUND_BEFORE, AROUND_AFTER = 200, 400

ANY_CASE = re.IGNORECASE | re.DOTALL
FACTS = T.StructType([
    *(T.StructField(x, T.StringType()) for x in ("fund_name", "fund_ticker", "registrant")), T.StructField("exchange_listed", T.BooleanType()),
    T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("ticker", T.StringType())]))),
    T.StructField("entries", ENTRIES), T.StructField("election", EFFECTIVENESS),
    T.StructField("error", T.StringType()),
])


class Lines:
    """Text nodes, one a line, and the text of the first span of class companyName."""

    def __init__(self, text: str) -> None:
        self.nodes: list[str] = []
        self.company: list[str] = []
        spans: list[bool] = []
        done, silent = False, 0
        for kind, value, classes, _ in walk(text):
            if kind == DATA:
                if not silent:
                    self.nodes.append(value)
                    if spans and any(spans):
                        self.company.append(value)
            elif value in ("script", "style"):
                silent = silent + 1 if kind == START else max(0, silent - 1)
            elif value == "span":
                if kind == START:
                    named = "companyName" in classes
                    spans.append(named and not done and not any(spans))
                elif spans and spans.pop():
                    done = True


def holds_any(text: str, words: Sequence[str]) -> bool:
    for x in words:
        if x in text:
            return True
    return False


class Document:
    """A document and its derived forms, each made at most once."""

    def __init__(self, text: str | None) -> None:
        self.raw = text or ""

    @cached_property
    def plain(self) -> str:
        return clean(self.raw)

    @cached_property
    def low(self) -> str | None:
        """The document in lower case, if it is of plain characters, in which no other letters stand for these."""
        return self.raw.lower() if self.raw.isascii() else None

    @cached_property
    def folded(self) -> str:
        return self.plain.casefold()

    def may_match(self, literals: Sequence[str], choices: Sequence[Sequence[str]] = ()) -> bool:
        """Whether all words that a pattern needs are in the flattened text, and of each choice one."""
        for x in literals:
            if x not in self.folded:
                return False
        for words in choices:
            if not holds_any(self.folded, words):
                return False
        return True

    @cached_property
    def walked(self) -> Lines:
        return Lines(self.raw)

    @cached_property
    def lines(self) -> list[str]:
        return [clean(x) for x in "\n".join(self.walked.nodes).splitlines()]


#: Words that a match of a pattern holds wherever the pattern has what stands beside them: without them a text need not be searched.
LITERALS = (
    (r"\|", "|"), (r"is\s+listed\s+on\b", "is listed on"), (r"Class/Contract", "class/contract"), (r'ticker\s+symbol\s+"', "ticker symbol"), (r"ProShares\s+", "proshares"),
    (r"Principal U\.S\. Listing", "principal u.s. listing"), (r"\(\s*" + TICKER, "("),
)
#: Parts of patterns that match one of some words, of which a match of the pattern holds one.
KINDS, LISTED_KINDS = ("etf", "fund"), ("exchange-traded fund", "exchange traded fund")
CHOICES = ((r"(?:ETF|Fund)", KINDS), (EXCHANGE_WORDS, ("nyse", "nasdaq", "cboe", "arca", "bzx", "exchange")), (r"exchange[- ]traded fund", LISTED_KINDS), (SHARES, ("fund",)))


def needed(pattern: str) -> tuple[str, ...]:
    """The literals that every match of a pattern holds; what stands inside a look ahead does not count."""
    outside = re.sub(r"\(\?=.*", "", pattern)
    return tuple(literal for part, literal in LITERALS if part in outside)


def choices(pattern: str) -> tuple[tuple[str, ...], ...]:
    """The words of which every match of a pattern holds one, for each such part of it."""
    outside = re.sub(r"\(\?=.*", "", pattern)
    return tuple(words for part, words in CHOICES if part in outside)


#: Patterns that more than one document is searched by, made once, and the literals that each needs.
PAIR_SEARCHES = tuple((re.compile(p, re.IGNORECASE), needed(p), choices(p)) for p in PAIR_PATTERNS)
LINE_SEARCHES = tuple(re.compile(p, re.IGNORECASE) for p in PAIR_LINES)
HEADING, LISTED_SEARCHES, AT_MARKET = re.compile(f"^{PAIR_HEADING}", re.IGNORECASE), tuple((re.compile(p, re.IGNORECASE), needed(p), choices(p)) for p in LISTED), re.compile(AT_MARKET_PRICES, re.IGNORECASE)
FUND_CELL, WORDS, LISTED_TICKER = re.compile("ETF|FUND"), re.compile("[A-Z0-9]+"), re.compile(r"[A-Z]{2,5}")


class Rule(NamedTuple):
    """How a value is read: `read` gives it, or nothing."""

    read: Callable[[Document], str]

    @classmethod
    def plain(cls, pattern: str, group: str, flags: int = re.IGNORECASE) -> Rule:
        compiled, literals, words = re.compile(pattern, flags), needed(pattern), choices(pattern)
        return cls(lambda d: m[group].strip() if d.may_match(literals, words) and (m := compiled.search(d.plain)) else "")

    @classmethod
    def markup(cls, pattern: str, group: str) -> Rule:
        compiled, word = re.compile(pattern, ANY_CASE), SERIES_CELL.lower()
        times = pattern.count(SERIES_CELL)
        return cls(lambda d: clean(m[group]) if (not times or d.low is None or d.low.count(word) >= times) and (m := compiled.search(d.raw)) else "")


def first(rules: Sequence[Rule], document: Document, good: Callable[[str], object] = bool) -> str:
    """The value of the first rule that gives one that is good."""
    return next(filter(good, (rule.read(document) for rule in rules)), "")


def _listed_ticker(value: str) -> str:
    """A word of two to five capitals that is no common word, else nothing."""
    word = value.strip().upper()
    return word if LISTED_TICKER.fullmatch(word) and word not in fixed.DENIED_TICKERS else ""


def _class_name(document: Document) -> str:
    found = document.may_match(needed(NAME_OF_CLASS)) and re.search(NAME_OF_CLASS, document.plain, re.IGNORECASE)
    return name_and_ticker(found["name"])[0] if found else ""


def _row_ticker(document: Document) -> str:
    row = re.search(TICKER_ROW, document.raw, ANY_CASE)
    cells = re.findall(TICKER_CELL, row[1], ANY_CASE) if row else []
    last = clean(cells[-1]).upper() if cells else ""
    return last if re.fullmatch("[A-Z]{3,4}", last) else ""


def _labelled_ticker(document: Document) -> str:
    label = (document.low is None or "ticker symbol" in document.low) and re.search("Ticker Symbol", document.raw, re.IGNORECASE)
    found = label and re.search(TICKER_LABEL, clean(document.raw[label.start():label.start() + LABEL_CHARS]), re.IGNORECASE)
    return found["ticker"] if found else ""


NAME_RULES = (
    *(Rule.plain(p, "name") for p in NAME_PATTERNS), Rule(_class_name), *(Rule.markup(p, "name") for p in NAME_MARKUP), Rule.plain(NAME_LAST, "name", 0),
)
TICKER_RULES = (
    Rule.plain(TICKER_BRACKETED, "ticker"), Rule(_row_ticker), *(Rule.plain(p, "ticker") for p in TICKER_LISTED), Rule(_labelled_ticker),
    *(Rule.plain(p, "ticker") for p in TICKER_LAST),
)


def fund_name(document: Document) -> str:
    return first(NAME_RULES, document) or NO_NAME


def fund_ticker(document: Document, pairs: Sequence[tuple[str, str]]) -> str:
    """The ticker of a sole pair, else that of the first rule with one that is no common word."""
    if len(pairs) == 1:
        return pairs[0][1]
    return first(TICKER_RULES, document, lambda x: x and x.upper() not in fixed.DENIED_TICKERS).upper()


def _cell_pairs(document: Document) -> Iterator[tuple[str, str]]:
    """Of rows that are no heading: a cell that holds both, or a fund's cell and the ticker in the next."""
    both = PAIR_SEARCHES[0][0]
    for row in rows_of(document.raw, ("td", "th")):
        cells = [x for x in (c.text for c in row.cells) if x]
        if any("ticker symbol" in x.lower() for x in cells):
            continue
        for cell, after in zip(cells, [*cells[1:], ""]):
            if "(" in cell and (found := both.search(cell)):
                yield found["name"], found["ticker"]
            if FUND_CELL.search(cell.upper()):
                yield cell, after


def _text_pairs(document: Document) -> Iterator[tuple[str, str]]:
    for pattern, literals, words in PAIR_SEARCHES:
        for found in pattern.finditer(document.plain) if document.may_match(literals, words) else ():
            yield HEADING.sub("", found["name"]), found["ticker"]
    for line in document.lines if holds_any(document.folded, KINDS) else ():
        for pattern in LINE_SEARCHES if holds_any(line.casefold(), KINDS) else ():
            if found := pattern.fullmatch(line):
                yield found["name"], found["ticker"]


def name_ticker_pairs(document: Document) -> list[tuple[str, str]]:
    """Distinct pairs in order; names are compared by their capitals and digits, and hold "ETF"."""
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for source in (_cell_pairs, _text_pairs):
        for name, symbol in source(document):
            name, symbol = clean(name), _listed_ticker(symbol)
            if symbol and "ETF" in name.upper():
                out.setdefault((" ".join(WORDS.findall(name.upper())), symbol), (name, symbol))
    return list(out.values())


def _above_mark(document: Document) -> str:
    """The nearest of the lines above the charter mark that has a letter."""
    for at, line in enumerate(document.lines):
        if REGISTRANT_MARK in line:
            for above in reversed(document.lines[max(0, at - REGISTRANT_LINES):at]):
                if re.search("[A-Za-z]", above):
                    return above
    return ""


def _before_mark(document: Document) -> str:
    """The run of name characters that ends at the first mark in brackets with one before it. The text is read backwards from each
    mark to the one before: a name holds no bracket, so nothing is read twice."""
    at = 0
    for mark in re.finditer(REGISTRANT_AFTER, document.plain, re.IGNORECASE):
        if run := re.match(REGISTRANT_CHARS, document.plain[at:mark.start()][::-1], re.IGNORECASE):
            return run[0][::-1].strip()
        at = mark.end()
    return ""


REGISTRANT_RULES = (
    Rule(lambda d: re.sub(r"\s*\(Filer\).*", "", clean(" ".join(x.strip() for x in d.walked.company)), flags=re.IGNORECASE)),
    Rule.markup(REGISTRANT_SPAN, "name"), Rule(_above_mark), Rule(_before_mark),
)


def registrant(document: Document) -> str:
    return first(REGISTRANT_RULES, document).upper()


def exchange_listed(document: Document) -> bool:
    """Whether the fund's own shares are said to be on an exchange; a comparison with such funds does not count."""
    if any(document.may_match(literals, words) and p.search(document.plain) for p, literals, words in LISTED_SEARCHES):
        return True
    return "at market pr" in document.folded and any(
        re.search(rf"\b{EXCHANGE}\b", document.plain[max(0, m.start() - AROUND_BEFORE):m.end() + AROUND_AFTER], re.IGNORECASE)
        for m in AT_MARKET.finditer(document.plain))


def facts(text: str | None, window: str | None) -> tuple:
    """A row of FACTS: of the identity text, and of the cover window its election."""
    try:
        document = Document(text)
        pairs = name_ticker_pairs(document)
        return (fund_name(document), fund_ticker(document, pairs), registrant(document), exchange_listed(document),
                [dict(zip(("name", "ticker"), x)) for x in pairs], series_entries(text), election_or_blank(window), None)
    except Exception as error:  # a document that cannot be read is its filer's failure, not the job's
        return NO_NAME, "", "", False, [], [], election_or_blank(None), f"{type(error).__name__}: {error}"


FACTS_ARROW = to_arrow_type(FACTS)


@F.arrow_udf(FACTS)
def facts_of(text: pa.Array, window: pa.Array) -> pa.Array:
    found: dict[tuple, dict] = {}  # documents that are alike are read once
    asked = list(zip(text.to_pylist(), window.to_pylist()))
    for x in asked:
        if x not in found:
            found[x] = dict(zip(FACTS.names, facts(*x)))
    return pa.array([found[x] for x in asked], FACTS_ARROW)
