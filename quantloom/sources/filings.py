"""Nested filings as tables: transactions of insiders (XML), facts of companies (JSON), holdings of managers (tabbed text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Forms that report on a year, and how a footnote names a plan that sells by itself.
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "40-F")
PLAN = r"(?i)10b5[-\u2010-\u2014]?\s*1|rule\s*10b5"

_VALUE = "struct<value:string,footnoteId:array<struct<_id:string>>>"
#: The elements of an ownership document that are read.
OWNERSHIP = f"""
reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>>,
nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string,footnoteId:array<struct<_id:string>>>,
transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>>>>,
footnotes struct<footnote:array<struct<_VALUE:string,_id:string>>>
"""


def insider_transactions(filings: DataFrame, key: str, xml: str) -> DataFrame:
    """A row for each transaction of an ownership document: ``key, name, role, date, code, side, shares, price, value, planned``.

    The role is the officer's title, else director, else large owner. A transaction is planned if a footnote it points to names a plan.
    Documents that are missing or don't parse have no rows; numbers that don't parse are missing, and so is their product.
    """
    d = filings.select(key, F.from_xml(F.col(xml), OWNERSHIP.replace("\n", " ").strip(), {"mode": "PERMISSIVE", "rowTag": "ownershipDocument"}).alias("d"))
    yes = lambda c: F.trim(c).isin("1", "true")
    owner = F.get("d.reportingOwner", F.lit(0))
    rel = owner["reportingOwnerRelationship"]
    title = F.coalesce(F.nullif(F.trim(rel["officerTitle"]), F.lit("")), F.lit("Officer"))
    role = F.when(yes(rel["isOfficer"]), title).when(yes(rel["isDirector"]), "Director").when(yes(rel["isTenPercentOwner"]), "10% owner").otherwise("")
    t = d.select(key, F.coalesce(F.trim(owner["reportingOwnerId"]["rptOwnerName"]), F.lit("")).alias("name"), role.alias("role"), F.col("d.footnotes.footnote").alias("notes"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    amounts = F.col("t.transactionAmounts")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    no_notes = F.array().cast("array<struct<_id:string>>")
    pointed = F.flatten(F.array(*(F.coalesce(c["footnoteId"], no_notes) for c in (F.col("t.transactionDate"), F.col("t.transactionCoding"), *(amounts[x] for x in ("transactionShares", "transactionPricePerShare", "transactionAcquiredDisposedCode"))))))
    plans = F.transform(F.filter(F.coalesce("notes", F.array().cast("array<struct<_VALUE:string,_id:string>>")), lambda n: F.regexp_like(F.coalesce(n["_VALUE"], F.lit("")), F.lit(PLAN))), lambda n: n["_id"])
    shares, price = number(amounts["transactionShares"]["value"]), number(amounts["transactionPricePerShare"]["value"])
    return t.select(
        key, "name", "role", text(F.col("t.transactionDate.value")).alias("date"), text(F.col("t.transactionCoding.transactionCode")).alias("code"), text(amounts["transactionAcquiredDisposedCode"]["value"]).alias("side"),
        shares.alias("shares"), price.alias("price"), F.when((shares != 0) & (price != 0), shares * price).alias("value"), F.coalesce(F.arrays_overlap(F.transform(pointed, lambda p: p["_id"]), plans), F.lit(False)).alias("planned"),
    )


_FACT = "array<struct<end:string,val:double,fy:int,fp:string,form:string,filed:string>>"


def annual_series(facts: DataFrame, key: str, json: str, concepts: Sequence[str], unit: str = "USD") -> DataFrame:
    """``key, concept, fy, end, value``: for each company the yearly points of the first concept that it has in that unit; of points of a
    fiscal year the one filed last (the last listed of equals). Points count if their form is a yearly one or their period is the
    whole year. What is missing or doesn't parse has no rows."""
    f = facts.select(key, F.from_json(json, f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,{_FACT}>>>>>").alias("d"))
    of = F.col("d")["facts"]["us-gaap"]
    has = F.filter(F.array(*(F.struct(F.lit(c).alias("concept"), of[c]["units"][unit].alias("rows")) for c in concepts)), lambda x: F.size(x["rows"]) > 0)
    p = f.select(key, F.get(has, F.lit(0)).alias("c")).select(key, "c.concept", F.posexplode("c.rows").alias("i", "p")).where("p.val is not null and p.end is not null and p.fy is not null")
    p = p.where(F.coalesce(F.col("p.form"), F.lit("")).isin(*ANNUAL_FORMS) | (F.coalesce(F.col("p.fp"), F.lit("")) == "FY"))
    last = F.max_by("p", F.struct(F.coalesce("p.filed", F.lit("")), "i")).alias("p")
    return p.groupBy(key, "concept", F.col("p.fy").alias("fy")).agg(last).select(key, "concept", "fy", F.col("p.end").alias("end"), F.col("p.val").alias("value"))


def holdings_table(spark: SparkSession, path: str, only_shares: bool = True) -> DataFrame:
    """``cusip, issuer, value, shares, holders`` of tabbed text files with a header: options don't count, shares only of rows of type SH (unless
    ``only_shares`` is off), holders are the different filings. Columns are found by name, whatever their case and order; those
    that a file lacks are empty, numbers that don't parse count as zero."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    found = {c.strip().upper(): c for c in raw.columns}
    col = lambda name: F.trim(F.coalesce(F.col(f"`{found[name]}`"), F.lit(""))) if name in found else F.lit("")
    number = lambda name: F.coalesce(col(name).try_cast("double"), F.lit(0.0))
    t = raw.select(F.upper(col("CUSIP")).alias("cusip"), col("NAMEOFISSUER").alias("issuer"), number("VALUE").alias("value"), number("SSHPRNAMT").alias("n"), F.upper(col("SSHPRNAMTTYPE")).alias("kind"), col("PUTCALL").alias("option"), col("ACCESSION_NUMBER").alias("filing"))
    t = t.where("cusip <> '' and option = ''")
    counts = F.lit(True) if not only_shares else F.col("kind") == "SH"
    return t.groupBy("cusip").agg(F.min("issuer").alias("issuer"), F.sum("value").alias("value"), F.sum(F.when(counts, F.col("n")).otherwise(0.0)).alias("shares"), F.countDistinct(F.nullif("filing", F.lit(""))).alias("holders"))
