"""Security code forms and the asset class behind a code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading digits of an exchange code by market and by asset class.
SHANGHAI = "^[569]"
BEIJING = "^[48]"
CONVERTIBLE = "^(11|12)"
FUND = "^(15|16|50|51|52|56|58)"
SHARE = "^(0|3|60|68|4|8|9)"


def normalize_code(raw: Column) -> Column:
    """``600000``, ``SH600000`` or ``600000.SH`` -> ``sh.600000``; CASH stays; anything else is missing."""
    low = F.lower(F.trim(raw))
    digits = F.regexp_extract(low, "([0-9]{6})", 1)
    market = F.regexp_extract(low, "(sh|sz|bj)", 1)
    guess = F.when(digits.rlike(SHANGHAI), "sh").when(digits.rlike(BEIJING), "bj").otherwise("sz")
    full = F.concat_ws(".", F.when(market != "", market).otherwise(guess), digits)
    return F.when(low == "cash", "CASH").when(digits != "", full)


def asset_class(code: Column) -> Column:
    number = F.element_at(F.split(code, r"\."), -1)
    return (
        F.when(code == "CASH", "cash")
        .when(number.rlike(CONVERTIBLE), "convertible_bond")
        .when(number.rlike(FUND), "etf")
        .when(number.rlike(SHARE), "stock")
        .otherwise("other")
    )
