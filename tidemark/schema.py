"""Schemas of inputs and results, and the checks at their borders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIVERSE = "ticker string, name string, sector string, cik long, date_added date"
ANNOUNCEMENTS = "ticker string, cik long, accession string, filing_date date, accepted_utc timestamp"
QUARTERLY_EPS = "ticker string, cik long, start date, end date, val double, filed date, days int, derived boolean"
EPS_FACTS = "cik long, tag string, start date, end date, val double, filed date, form string, fy int, fp string, days int"
PRICES = "session date, ticker string, open double, close double"
FACTORS = "date date, mkt_rf double, smb double, hml double, mom double, rf double"
CONSENSUS = "ticker string, announced_date date, eps_estimate double, eps_actual double, yahoo_surprise_pct double"
TEST_RESULT = "label string, metric string, estimate double, std_error double, statistic double, p_value double, n_obs long, n_clusters long, method string, ci_low double, ci_high double"


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what}: missing columns: {missing}")
    return df


def null_nans(df: DataFrame) -> DataFrame:
    """NaN means missing at every source; inside the engine missing is NULL, which comparisons and means skip."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df
