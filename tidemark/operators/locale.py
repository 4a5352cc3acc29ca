"""Locales and message catalogs as lookups of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
DEFAULT, SUPPORTED, FRENCH_COUNTRIES = "fr", ("fr", "en"), ("FR", "BE", "LU", "MC")


def to_locale(tag: Column) -> Column:
    """The language of a tag such as en-US; French for anything unsupported."""
    base = F.split_part(F.lower(tag), F.lit("-"), F.lit(1))
    return F.when(F.coalesce(base.isin(*SUPPORTED), F.lit(False)), base).otherwise(DEFAULT)


def _given(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def detect(override: Column, accept: Column, country: Column) -> Column:
    """An explicit choice, else the first accepted language, else the country, else French."""
    first = F.trim(F.split_part(accept, F.lit(","), F.lit(1)))
    by_country = F.when(F.upper(country).isin(*FRENCH_COUNTRIES), "fr").otherwise(DEFAULT)
    return F.when(_given(override), to_locale(override)).when(_given(accept) & _given(first), to_locale(first)).otherwise(by_country)


def resolve(override: Column, cookie: Column, accept: Column, country: Column) -> Column:
    """As detect, with a remembered choice after the explicit one."""
    return F.when(_given(override), to_locale(override)).when(_given(cookie), to_locale(cookie)).otherwise(detect(F.lit(None).cast("string"), accept, country))


def language_name(locale: Column) -> Column:
    return F.when(locale == "fr", "French").otherwise("English")


def translate(asked: DataFrame, messages: DataFrame, key: str = "key", locale: str = "locale") -> DataFrame:
    """asked plus `text`: the message of its locale, else the default locale's, else the key itself.

    One join: both candidates of a key come as a map, whatever the number of locales."""
    by_key = messages.groupBy(F.col("key").alias("_k")).agg(F.map_from_entries(F.collect_set(F.struct("locale", "text"))).alias("_m"))
    out = asked.join(by_key, F.col(key) == F.col("_k"), "left")
    text = F.coalesce(F.try_element_at("_m", F.col(locale)), F.try_element_at("_m", F.lit(DEFAULT)), F.col(key))
    return out.withColumn("text", text).drop("_k", "_m")


def interpolate(template: Column, values: Column) -> Column:
    """Replaces {name} by the map's value; unknown names stay. Values are not searched again."""
    parts = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    between = F.split(template, r"\{\w+\}")
    filled = F.transform(parts, lambda name, i: F.concat(F.get(between, i), F.coalesce(F.try_element_at(values, name), F.concat(F.lit("{"), name, F.lit("}")))))
    return F.concat(F.array_join(filled, ""), F.get(between, F.size(parts)))
