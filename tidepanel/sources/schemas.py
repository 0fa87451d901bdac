"""Explicit schemas of the landed files; nothing is inferred."""

BARS = "ticker string, d date, open double, high double, low double, close double, volume double"
RAW_BARS = ("Ticker string, Date timestamp, Open double, High double, Low double, Close double, "
            "Volume double, Dividends double")
SECONDARY = "Date date, Open double, High double, Low double, Close double, Volume double"
MONTHLY_INDEX = "data array<array<string>>"
FILINGS = ("filings struct<recent: struct<form: array<string>, filingDate: array<string>, "
           "accessionNumber: array<string>, primaryDocument: array<string>, items: array<string>>>")
ISSUERS = "map<string, struct<ticker: string, cik_str: string>>"
MANUAL_EVENTS = "date string, ticker string, category string, label string, source string, url string"
HOLDING_ALIASES = ("Holding Ticker", "HoldingTicker", "Ticker", "Symbol")
