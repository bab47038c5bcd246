"""Typed values of facts, as a struct, and the comparison rules on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<vtype:string,s:string,num:double,unit:string,y:int,d:date>"


def value(vtype: str | Column, s=None, num=None, unit=None, y=None, d=None) -> Column:
    """A typed value: string, quantity (with unit), year or date."""
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(lit(vtype, "string").alias("vtype"), lit(s, "string").alias("s"), lit(num, "double").alias("num"), lit(unit, "string").alias("unit"), lit(y, "int").alias("y"), lit(d, "date").alias("d"))


def parse_value(text: Column, vtype: Column | str) -> Column:
    """Target text as a typed value. Quantity: number and unit (1 if none); time: a date if it has / or an inner -, else a year."""
    kind = F.lit(vtype) if isinstance(vtype, str) else vtype
    text = F.trim(text)
    first, rest = F.split_part(text, F.lit(" "), F.lit(1)), F.regexp_extract(text, r"^\S+ +(.*)$", 1)
    num = first.try_cast("double")
    dated = text.contains("/") | F.substring(text, 2, 1000).contains("-")
    parts = F.split(text, "[/-]")
    day = F.try_make_timestamp(F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return (
        F.when(kind == "string", value("string", s=text))
        .when(kind == "quantity", value("quantity", num=num, unit=F.when(rest == "", "1").otherwise(rest)))
        .when(dated, value("date", d=day))
        .otherwise(value("year", y=text.try_cast("int")))
    )


def year_of(v: Column) -> Column:
    return F.when(v["vtype"] == "year", v["y"]).otherwise(F.year(v["d"]))


def is_time(v: Column) -> Column:
    return v["vtype"].isin("year", "date")


def comparable(v: Column, t: Column) -> Column:
    return F.when(v["vtype"] == "string", t["vtype"] == "string").when(v["vtype"] == "quantity", (t["vtype"] == "quantity") & (t["unit"] == v["unit"])).otherwise(is_time(t))


def contains(t: Column, v: Column) -> Column:
    """Whether time t contains v: a year its dates, a date just itself."""
    return F.when(t["vtype"] == "year", year_of(v) == t["y"]).otherwise((v["vtype"] == "date") & (v["d"] == t["d"]))


def compare(v: Column, t: Column, op: Column | str) -> Column:
    """v op t for comparable values; `=` of a time target means that it contains v. Strings have no order (null)."""
    op = F.lit(op) if isinstance(op, str) else op
    same = F.when(is_time(t), contains(t, v)).when(v["vtype"] == "string", v["s"] == t["s"]).otherwise(v["num"] == t["num"])
    both_dates = (v["vtype"] == "date") & (t["vtype"] == "date")
    less = F.when(v["vtype"] == "quantity", v["num"] < t["num"]).when(both_dates, v["d"] < t["d"]).when(is_time(v), year_of(v) < year_of(t))
    more = F.when(v["vtype"] == "quantity", v["num"] > t["num"]).when(both_dates, v["d"] > t["d"]).when(is_time(v), year_of(v) > year_of(t))
    got = F.when(op == "=", same).when(op == "!=", ~same).when(op == "<", less).when(op == ">", more)
    return F.coalesce(comparable(v, t) & got, F.lit(False))


def text_of(v: Column) -> Column:
    """Value as text: whole quantities without decimals, unit 1 hidden."""
    whole = v["num"] == F.floor(v["num"])
    num = F.when(whole, v["num"].cast("bigint").cast("string")).otherwise(v["num"].cast("string"))
    quantity = F.when(v["unit"] == "1", num).otherwise(F.concat_ws(" ", num, v["unit"]))
    return F.when(v["vtype"] == "string", v["s"]).when(v["vtype"] == "quantity", quantity).when(v["vtype"] == "year", v["y"].cast("string")).when(v["vtype"] == "date", v["d"].cast("string"))


def order_of(v: Column) -> Column:
    """A number that orders values of one kind: quantities by number, times by day."""
    return F.when(v["vtype"] == "quantity", v["num"]).when(v["vtype"] == "year", v["y"].cast("double") * 366).when(v["vtype"] == "date", F.year(v["d"]) * 366.0 + F.dayofyear(v["d"]))
