"""A supplied contact table as records: gift histories in text, their aggregates, tiers as segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SEGMENT_OF_TIER = {"Platinum": "principal", "Gold": "major", "Silver": "mid_value", "Lapsed": "lapsed", "Bronze": "general"}
ONE_GIFT = "([1-9][0-9]{3}): \\$(0|[1-9][0-9]{0,2}(?:,[0-9]{3})*)"


def gifts(text: Column) -> Column:
    """array<struct<year, amount>> of '2010: $25,000, 2013: $30,000'; null unless the whole text has this form and the years rise.

    Amounts have their thousands grouped and no leading zero. Null and empty texts give null.
    """
    whole = text.rlike(f"^{ONE_GIFT}(?:, {ONE_GIFT})*\\z")
    part = lambda group: F.regexp_extract_all(text, F.lit(ONE_GIFT), F.lit(group))
    years, amounts = (F.transform(part(g), lambda x: F.regexp_replace(x, ",", "").cast("bigint")) for g in (1, 2))
    rising = F.forall(F.transform(years, lambda y, i: (i == 0) | (y > F.get(years, i - 1))), lambda ok: ok)
    found = F.zip_with(years, amounts, lambda y, a: F.struct(y.cast("int").alias("year"), a.alias("amount")))
    return F.when(whole & rising, found)


def aggregates(found: Column) -> dict[str, Column]:
    """largest, lifetime, last_amount and last_year of a gift array; null for null."""
    amounts, last = F.transform(found, lambda g: g["amount"]), F.element_at(found, -1)
    return {"largest": F.array_max(amounts), "lifetime": F.aggregate(amounts, F.lit(0).cast("bigint"), lambda a, x: a + x), "last_amount": last["amount"], "last_year": last["year"]}


def segment(tier: Column) -> Column:
    """The segment of a tier; null for any other."""
    out = F.lit(None).cast("string")
    for name, found in SEGMENT_OF_TIER.items():
        out = F.when(tier == name, F.lit(found)).otherwise(out)
    return out


def summarized(df: DataFrame, gifts_col: str = "gifts", tier_col: str = "tier", largest_col: str = "largest_gift", lifetime_col: str = "lifetime_total", year_col: str = "last_gift_year") -> DataFrame:
    """df with gift_list, the aggregates, segment and `consistent`: whether the stated totals are those of the history."""
    rows = df.withColumn("gift_list", gifts(F.col(gifts_col)))
    found = aggregates(F.col("gift_list"))
    same = (found["largest"] == F.col(largest_col)) & (found["lifetime"] == F.col(lifetime_col)) & (found["last_year"] == F.col(year_col))
    return rows.withColumns({f"gift_{k}": v for k, v in found.items()} | {"segment": segment(F.col(tier_col)), "consistent": F.coalesce(same, F.lit(False))})
