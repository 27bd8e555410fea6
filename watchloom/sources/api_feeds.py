"""Readers of landed JSON pages and workbooks: Wikidata, US Congress, UK Parliament, FBI, Australia."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import messy_date
from .common import canonical_gender, entries, joined, none_if_blank, some, t, texts


def read_wikidata(spark: SparkSession, path: str) -> DataFrame:
    """Landed SPARQL results, one folder ``country=XX`` each; the first row of a person holds (countries in order)."""
    v = "struct<value:string>"
    df = spark.read.schema(f"country string, results struct<bindings:array<struct<person:{v},personLabel:{v},positionLabel:{v},startDate:{v},endDate:{v}>>>").option("multiLine", "true").json(path)
    rows = df.select("country", F.posexplode("results.bindings").alias("at", "b"))
    qid = F.element_at(F.split(t("b.person.value"), "/"), -1)
    rows = rows.withColumn("qid", qid).filter("qid <> ''").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("country", "at"))).filter("n = 1")
    label = t("b.personLabel.value")
    return entries(
        rows.filter((label != "") & (label != F.col("qid"))), id=F.concat(F.lit("wd-"), F.col("qid")), source=F.lit("wikidata_peps"), list_name=F.concat(F.lit("Wikidata PEPs ("), F.col("country"), F.lit(")")),
        names=F.array(label), alias_quality=F.array(F.lit("strong")), nationality=some(t("country")), designation=none_if_blank(t("b.positionLabel.value")),
        listed_on=none_if_blank(F.substring(t("b.startDate.value"), 1, 10)), source_url=F.col("b.person.value"), raw=F.to_json("b"),
    )


def read_congress(spark: SparkSession, path: str) -> DataFrame:
    """Legislators as JSON; the last term is the current one."""
    df = spark.read.schema("id struct<bioguide:string>, name struct<first:string,last:string>, bio struct<birthday:string,gender:string>, terms array<struct<type:string,state:string,party:string>>").option("multiLine", "true").json(path)
    full = joined(t("name.first"), t("name.last"))
    last = F.get("terms", F.size("terms") - 1)
    return entries(
        df.filter(full != ""), id=F.concat(F.lit("usc-"), F.when(t("id.bioguide") != "", t("id.bioguide")).otherwise(F.replace(full, F.lit(" "), F.lit("_")))), source=F.lit("us_congress"), list_name=F.lit("US Congress (Current Members)"),
        names=F.array(full), alias_quality=F.array(F.lit("strong")), dob=some(t("bio.birthday")), nationality=F.array(F.lit("US")), gender=canonical_gender(F.col("bio.gender")),
        designation=F.when(t(last["type"]) != "", F.concat(F.upper(t(last["type"])), F.lit(" - "), t(last["state"]), F.lit(" ("), t(last["party"]), F.lit(")"))),
    )


def read_uk_parliament(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of the members API; a page read twice counts once."""
    df = spark.read.schema("items array<struct<value:struct<id:string,nameDisplayAs:string,gender:string,latestHouseMembership:struct<house:string,membershipFrom:string>>>>").option("multiLine", "true").json(path)
    m = df.select(F.explode("items.value").alias("v")).select("v.*").distinct()
    house = F.when(t("latestHouseMembership.house") == "1", "House of Commons").when(t("latestHouseMembership.house") == "2", "House of Lords").otherwise(t("latestHouseMembership.house"))
    return entries(
        m.filter(t("nameDisplayAs") != ""), id=F.concat(F.lit("ukp-"), t("id")), source=F.lit("uk_parliament"), list_name=F.lit("UK Parliament (Current Members)"), names=F.array(t("nameDisplayAs")), alias_quality=F.array(F.lit("strong")),
        nationality=F.array(F.lit("GB")), gender=canonical_gender(F.col("gender")), designation=joined(house, t("latestHouseMembership.membershipFrom"), sep=" - "),
    )


def read_fbi(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of the wanted API."""
    item = "struct<uid:string,title:string,aliases:array<string>,dates_of_birth_used:array<string>,nationality:string,sex:string,description:string,url:string,subjects:array<string>>"
    df = spark.read.schema(f"items array<{item}>").option("multiLine", "true").json(path)
    m = df.select(F.explode("items").alias("v")).select("v.*").distinct()
    title = t("title")
    return entries(
        m.filter(title != ""), id=F.concat(F.lit("fbi-"), F.when(t("uid") != "", t("uid")).otherwise(F.replace(title, F.lit(" "), F.lit("_")))), source=F.lit("fbi_wanted"), list_name=F.lit("FBI Most Wanted"),
        names=F.concat(F.array(title), F.filter(texts("aliases"), lambda a: a != title)), dob=texts("dates_of_birth_used"), nationality=texts(F.split(t("nationality"), ",")), gender=canonical_gender(F.col("sex")),
        designation=none_if_blank(t("description")), source_url=F.col("url"), raw=F.to_json(F.struct("description", "subjects")),
    )


def sheet_rows(content: bytes) -> list[list[str]]:
    """Cell texts of a workbook's first sheet."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                shared.append("".join(x.text or "" for x in si.iter(f"{ns}t")))
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{ns}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{ns}c"):
                letters = "".join(x for x in c.get("r", "A1") if x.isalpha())
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                if c.get("t") == "inlineStr":
                    text = "".join(x.text or "" for x in c.iter(f"{ns}t"))
                else:
                    v = c.find(f"{ns}v")
                    text = "" if v is None or v.text is None else v.text
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                cells[col - 1] = text
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


# Words of a header cell and the field they stand for, tried in order.
_HEADERS = (("reference", "ref"), ("name", "name"), ("type", "type"), ("date of birth", "dob"), ("dob", "dob"), ("place of birth", "pob"), ("pob", "pob"), ("nationality", "nationality"), ("citizenship", "nationality"), ("designation", "designation"), ("title", "designation"), ("listing", "listed_on"), ("alias", "alias"))
_AU = ("ref", "name", "alias", "dob", "pob", "nationality", "designation", "listed_on")


def read_australia(spark: SparkSession, path: str) -> DataFrame:
    """A workbook whose rows share a numeric reference base (101, 101a ...): one entry a base, first non-blank values hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = sheet_rows(content)
                head = [h.strip().lower() for h in rows[0]] if rows else []
                at: dict[str, int] = {}
                for i, h in enumerate(head):
                    f = next((f for w, f in _HEADERS if (h.startswith(w) if w == "name" else w in h)), None)
                    if f:
                        at.setdefault(f, i)
                data = [[(r[at[f]] if f in at and at[f] < len(r) else "") for f in _AU] for r in rows[1:]]
                yield pd.DataFrame([[i, *x] for i, x in enumerate(data)], columns=["at", *_AU])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "at int, " + ", ".join(f"{f} string" for f in _AU)).filter(t("ref") != "")
    base = F.coalesce(F.nullif(F.regexp_extract(t("ref"), r"^(\d+)", 1), F.lit("")), t("ref"))
    raw = raw.withColumn("base", base).withColumn("dob", messy_date(F.col("dob"))).withColumn("listed_on", messy_date(F.col("listed_on")))

    def values(c: str) -> F.Column:
        return F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", t(c).alias("v")))), lambda s: s["v"]), lambda x: x != ""))

    both = F.array_distinct(F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.array(t("name"), t("alias")).alias("v")))), lambda s: s["v"])), lambda x: x != ""))
    g = raw.groupBy("base").agg(both.alias("names"), values("dob").alias("dob"), values("pob").alias("pob"), values("nationality").alias("nat"), values("designation").alias("des"), values("listed_on").alias("lo"), F.count("*").alias("n"))
    return entries(
        g, id=F.concat(F.lit("au-"), F.col("base")), source=F.lit("australia_dfat"), list_name=F.lit("Australian DFAT Consolidated Sanctions List"), names=F.col("names"), dob=F.col("dob"),
        dob_approximate=F.exists("dob", lambda d: F.contains(d, F.lit("~")) | (F.length(d) == 9)), pob=F.col("pob"), nationality=F.col("nat"), designation=F.get("des", F.lit(0)), listed_on=F.get("lo", F.lit(0)),
        raw=F.to_json(F.struct(F.col("base").alias("reference"), F.col("n").alias("row_count"))),
    )


def read_subjects(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Subjects in bulk from CSV with a header, or JSON; fields not given are empty."""
    fields = ("name", "dob", "nationality", "gender", "cnic", "passport", "pob", "father_name", "notes")
    df = spark.read.option("header", "true").csv(path) if kind == "csv" else spark.read.option("multiLine", "true").json(path)
    return df.select(*[t(f).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]).filter("name <> ''")


