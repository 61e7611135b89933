"""Clients of the public services that inputs come from. Prices and quotes need a package that may be missing; the error
says so when they are asked for. Each client is a callable that :mod:`tidemark.sources.fetch` takes, so others can stand in."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import UTC, date, datetime

from tidemark.sources.fetch import http_get

#: Public pages and files.
MEMBERS = "https://en.wikipedia.org/wiki/List_of_S%26P_500_companies"
FACTORS = "https://mba.tuck.dartmouth.edu/pages/faculty/ken.french/ftp/"
THREE_FACTORS, MOMENTUM = "F-F_Research_Data_Factors_daily_CSV.zip", "F-F_Momentum_Factor_daily_CSV.zip"
QUOTES = "earnings calendar of the price vendor"
#: Quarters asked for a company, and seconds between two companies.
QUARTERS, PAUSE = 40, 0.2


def today() -> str:
    return datetime.now(UTC).date().isoformat()


def members_page(agent: str) -> str:
    return http_get(MEMBERS, agent).decode()


def factor_file(agent: str) -> Callable[[str], bytes]:
    return lambda name: http_get(FACTORS + name, agent)


def _vendor():
    try:
        import yfinance
    except ImportError as e:
        raise RuntimeError("prices and quotes need the package yfinance, or another client") from e
    return yfinance


def prices(start: str, end: str) -> Callable[[Sequence[str]], Iterator[tuple[date, str, float, float]]]:
    """(session, ticker, open, close), adjusted, of a batch of tickers."""

    def batch(tickers: Sequence[str]) -> Iterator[tuple[date, str, float, float]]:
        got = _vendor().download(list(tickers), start=start, end=end, auto_adjust=True, progress=False, group_by="column", threads=True)
        if got is None or got.empty:
            return
        for t in got["Close"].columns:
            for day, open_, close in zip(got.index, got["Open"][t], got["Close"][t], strict=True):
                yield day.date(), t, float(open_), float(close)

    return batch


def quotes(sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Iterable[tuple]]:
    """(announced in UTC, estimate, actual, surprise) of a ticker; one that the vendor has no calendar for has none."""

    def of(ticker: str) -> list[tuple]:
        vendor = _vendor()
        try:
            frame = vendor.Ticker(ticker).get_earnings_dates(limit=QUARTERS)
        except Exception:  # the vendor's errors are of many kinds; a company without quotes is a gap in a cross-check
            frame = None
        sleep(PAUSE)
        if frame is None:
            return []
        known = lambda x: None if x is None or math.isnan(x) else float(x)
        surprise = frame["Surprise(%)"] if "Surprise(%)" in frame.columns else [math.nan] * len(frame)
        return [(t.tz_convert("UTC").tz_localize(None).to_pydatetime(), known(e), known(a), known(s)) for t, e, a, s in zip(frame.index, frame["EPS Estimate"], frame["Reported EPS"], surprise, strict=True)]

    return of
