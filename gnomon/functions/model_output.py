"""What a model returned: the JSON object in its text, and whether it is an extraction.

Finding the object needs a JSON decoder that says where it stopped, so it is a pandas UDF; all checks are columns.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gnomon.sources.model import ANCHOR, SPECIAL_KIND, TEFILLAH

# Names of fields, lengths, ranges and patterns of an extraction.
RULE = "struct<tefillah:string,tefillahLabel:string,daysOfWeek:array<double>,time:struct<kind:string,clock:string,anchor:string,offsetMin:double>,validFrom:string,validTo:string,specialScheduleKind:string,nusach:string,notes:string,sourceQuote:string>"
EXTRACTION = f"struct<confidence:double,reasoning:string,rules:array<{RULE}>,shulName:string,shulAddress:string,shulWebsite:string>"


def _no(name: str):
    raise ValueError(f"{name} is no JSON")


_JSON = json.JSONDecoder(parse_constant=_no)  # without NaN and infinities
_FENCE = re.compile(r"\A```(?:json|JSON)?\s*?\n|\n[ \t]*```\s*\Z")


def object_in(text: str) -> str:
    """The text between code fences if all of it is JSON, else the object at its first brace, else that text as it is."""
    body = _FENCE.sub("", text.strip()).strip()
    first = body.find("{")
    for start, whole in ((0, True), (first, False)):
        try:
            _, end = _JSON.raw_decode(body, start)
        except (ValueError, RecursionError):
            continue
        if not whole or end == len(body):
            return body[start:end]
    return body


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    """``object_in`` of each text; null for null."""
    return text.map(object_in, na_action="ignore")


def _short(value: Column, most: int) -> Column:
    return value.isNull() | (F.length(value) <= most)


def _dated(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^\d{4}-\d{2}-\d{2}$")


def valid_rule(r: Column) -> Column:
    """Whether one rule keeps to the domains, ranges, patterns and lengths."""
    time, whole = r["time"], lambda x: x == F.floor(x)
    days = r["daysOfWeek"].isNull() | F.forall(r["daysOfWeek"], lambda d: d.between(0, 6) & whole(d))
    fixed = (time["kind"] == "fixed") & time["clock"].rlike(r"^\d{1,2}:\d{2}$")
    sun = (time["kind"] == "zmanim") & time["anchor"].isin(*ANCHOR) & time["offsetMin"].isNotNull() & whole(time["offsetMin"])
    kind = r["specialScheduleKind"].isNull() | r["specialScheduleKind"].isin(*SPECIAL_KIND)
    ok = r["tefillah"].isin(*TEFILLAH) & days & (fixed | sun) & kind & _dated(r["validFrom"]) & _dated(r["validTo"])
    for name, most in (("tefillahLabel", 64), ("nusach", 32), ("notes", 280), ("sourceQuote", 500)):
        ok &= _short(r[name], most)
    return F.coalesce(ok, F.lit(False))


def extractions(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``extraction`` (null if there is none) and ``valid``: any breach rejects the whole of it.

    Rules without a specialScheduleKind are 'regular'. Rows with valid = false are the quarantine.
    """
    read = outputs.withColumn("extraction", F.from_json(json_object(F.col(text)), EXTRACTION, {"mode": "PERMISSIVE"}))
    e = F.col("extraction")
    ok = e["confidence"].between(0, 1) & e["reasoning"].isNotNull() & e["rules"].isNotNull() & _short(e["reasoning"], 800) & F.forall(e["rules"], valid_rule)
    for name, most in (("shulName", 200), ("shulAddress", 300), ("shulWebsite", 300)):
        ok &= _short(e[name], most)
    regular = F.transform(e["rules"], lambda r: r.withField("specialScheduleKind", F.coalesce(r["specialScheduleKind"], F.lit("regular"))))
    return read.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("extraction", F.when(e.isNotNull(), e.withField("rules", regular)))


def _texts(spark, sf_dir: str) -> DataFrame:
    from gnomon.sources.model import register, relation

    register(spark, sf_dir)
    return relation(spark, "model_text")


QUERIES = {"model_rules": lambda spark, sf_dir: extractions(_texts(spark, sf_dir)).select("id", "valid", F.when(F.col("valid"), F.col("extraction.confidence")).alias("confidence"), F.when(F.col("valid"), F.size("extraction.rules")).alias("rules"), F.when(F.col("valid"), F.get("extraction.rules", F.lit(0))["specialScheduleKind"]).alias("kind"))}
# What each text was made of says what must be read from it.
ORACLE = {"model_rules": """SELECT id, valid, CASE WHEN valid THEN confidence END AS confidence, CASE WHEN valid THEN n END AS rules, CASE WHEN valid AND n > 0 THEN 'regular' END AS kind
  FROM (SELECT o_orderkey AS id, o_orderkey % 8 IN (0, 1, 2, 6) AND o_custkey % 3 <> 2 AS valid, (o_orderkey % 100) / 100e0 AS confidence, CAST(o_custkey % 3 AS INT) AS n FROM orders)"""}
