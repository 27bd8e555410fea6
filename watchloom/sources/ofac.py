"""Reader of the advanced XML format: sections are read as tables and joined, never held as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_parts
from .common import entries, listed, t, xml

# Identifiers of the format's reference sets.
FEATURE = {"dob": "8", "pob": "9", "nationality": "10", "citizenship": "11", "address": "25", "gender": "224"}
PART_ORDER = {"1521": 1, "1522": 2, "91708": 3, "1520": 4}
LATIN = "215"
GENDER = {"91526": "male", "91527": "female"}

_DATE = "struct<Year:string,Month:string,Day:string>"
_PERIOD = f"struct<Start:struct<From:{_DATE},Year:string,Month:string,Day:string>,End:struct<To:{_DATE},Year:string,Month:string,Day:string>>"
_PART = "struct<NamePartValue:struct<_VALUE:string,_NamePartGroupID:string,_ScriptID:string>>"
_ALIAS = f"struct<_Primary:string,_LowQuality:string,DocumentedName:array<struct<DocumentedNamePart:array<{_PART}>>>>"
_GROUPS = "struct<MasterNamePartGroup:array<struct<NamePartGroup:struct<_ID:string,_NamePartTypeID:string>>>>"
_VERSION = f"struct<DatePeriod:{_PERIOD},VersionDetail:struct<_DetailReferenceID:string>,VersionLocation:struct<_LocationID:string>>"
_PROFILE = f"struct<_ID:string,_PartySubTypeID:string,Identity:struct<_ID:string,Alias:array<{_ALIAS}>,NamePartGroups:{_GROUPS}>,Feature:array<struct<_FeatureTypeID:string,FeatureVersion:{_VERSION}>>>"


def _reference(spark: SparkSession, path: str, tag: str, extra: str = "") -> DataFrame:
    """id, value and ``extra`` of a reference set; of equal ids the largest value holds."""
    cols = "_ID string, _VALUE string" + (f", {extra} string" if extra else "")
    df = xml(spark, path, tag, cols).filter("_ID is not null")
    return df.groupBy(F.col("_ID").alias("id")).agg(F.max(F.trim(F.col("_VALUE"))).alias("value"), *([F.max(extra).alias("parent")] if extra else []))


def individuals(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the party subtypes that are persons: two reference sets, joined."""
    kinds = _reference(spark, path, "PartyType").filter(F.lower("value") == "individual").select(F.col("id").alias("parent"))
    return _reference(spark, path, "PartySubType", "_PartyTypeID").join(kinds, "parent", "left_semi").select("id")


def _alias_names(aliases: Column, groups: Column) -> Column:
    """Structs (n, q): names assembled in the order first, middle, patronymic, family, others; primary aliases first."""
    kind = F.map_from_entries(F.transform(F.filter(listed(groups), lambda g: g["NamePartGroup"]["_ID"].isNotNull()), lambda g: F.struct(g["NamePartGroup"]["_ID"], t(g["NamePartGroup"]["_NamePartTypeID"]))))
    order = F.create_map(*[F.lit(x) for kv in PART_ORDER.items() for x in kv])

    def full(doc: Column) -> Column:
        parts = F.filter(listed(doc["DocumentedNamePart"]), lambda p: (t(p["NamePartValue"]["_VALUE"]) != "") & (F.coalesce(p["NamePartValue"]["_ScriptID"], F.lit(LATIN)) == LATIN))
        placed = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.element_at(order, F.element_at(kind, p["NamePartValue"]["_NamePartGroupID"])), F.lit(5)).alias("o"), i.alias("i"), t(p["NamePartValue"]["_VALUE"]).alias("v")))
        return F.array_join(F.transform(F.array_sort(placed), lambda p: p["v"]), " ")

    def of(a: Column) -> Column:
        q = F.when(F.lower(t(a["_LowQuality"])) == "true", "weak").otherwise("strong")
        return F.transform(listed(a["DocumentedName"]), lambda d: F.struct(full(d).alias("n"), q.alias("q")))

    first = F.filter(listed(aliases), lambda a: F.lower(t(a["_Primary"])) == "true")
    rest = F.filter(listed(aliases), lambda a: F.lower(t(a["_Primary"])) != "true")
    every = F.filter(F.flatten(F.transform(F.concat(first, rest), of)), lambda p: p["n"] != "")
    return F.aggregate(every, F.array().cast("array<struct<n:string,q:string>>"), lambda acc, p: F.when(F.exists(acc, lambda x: x["n"] == p["n"]), acc).otherwise(F.array_append(acc, p)))


def _period_text(p: Column) -> Column:
    """A birth date; a span of one whole year is that year."""

    def pick(side: Column, inner: str, f: str) -> Column:
        return F.coalesce(side[inner][f], side[f])

    y, m, d = (pick(p["Start"], "From", f) for f in ("Year", "Month", "Day"))
    y2, m2, d2 = (pick(p["End"], "To", f) for f in ("Year", "Month", "Day"))
    whole = (t(m) == "1") & (t(d) == "1") & (t(y2) == t(y)) & (t(m2) == "12") & (t(d2) == "31")
    return F.when(F.coalesce(whole, F.lit(False)), t(y)).otherwise(date_parts(y, m, d))


def read_ofac(spark: SparkSession, path: str, source: str = "ofac_sdn") -> DataFrame:
    party = xml(spark, path, "DistinctParty", f"_FixedRef string, Profile {_PROFILE}").filter("Profile.Identity is not null")
    party = party.join(individuals(spark, path).select(F.col("id").alias("st")), F.col("Profile._PartySubTypeID") == F.col("st"), "left_semi")
    base = party.select(
        F.col("Profile._ID").alias("pid"), F.coalesce("_FixedRef", F.col("Profile._ID")).alias("ref"), F.col("Profile.Identity._ID").alias("identity"),
        _alias_names(F.col("Profile.Identity.Alias"), F.col("Profile.Identity.NamePartGroups.MasterNamePartGroup")).alias("nm"), listed("Profile.Feature").alias("f"),
    ).filter(F.size("nm") > 0)

    countries, areas = _reference(spark, path, "Country"), _reference(spark, path, "AreaCode")
    value = "struct<Value:string>"
    loc = xml(spark, path, "Location", f"_ID string, LocationPart array<struct<LocationPartValue:array<{value}>>>, LocationCountry struct<_CountryID:string>").filter("_ID is not null")
    parts = F.filter(F.flatten(F.transform(listed("LocationPart"), lambda p: F.transform(listed(p["LocationPartValue"]), lambda v: t(v["Value"])))), lambda x: x != "")
    loc = loc.select(F.col("_ID").alias("loc"), parts.alias("parts"), F.col("LocationCountry._CountryID").alias("cid")).join(countries.select(F.col("id").alias("cid"), F.col("value").alias("country")), "cid", "left")
    place = loc.select("loc", F.array_join(F.when(F.col("country").isNotNull() & ~F.array_contains("parts", F.coalesce("country", F.lit(""))), F.array_append("parts", F.col("country"))).otherwise(F.col("parts")), ", ").alias("place")).groupBy("loc").agg(F.max("place").alias("place"))

    feats = base.select("pid", F.posexplode("f").alias("at", "x")).select("pid", "at", F.col("x._FeatureTypeID").alias("kind"), F.col("x.FeatureVersion.VersionLocation._LocationID").alias("loc"), F.col("x.FeatureVersion.VersionDetail._DetailReferenceID").alias("code"), _period_text(F.col("x.FeatureVersion.DatePeriod")).alias("born"))
    named = areas.select(F.col("id").alias("code"), F.col("value").alias("area")).join(countries.select(F.col("id").alias("code"), F.col("value").alias("land")), "code", "full_outer").select("code", F.coalesce("area", "land").alias("area"))
    feats = feats.join(place, "loc", "left").join(named, "code", "left")

    def gathered(what: Column, c: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(what & F.col(c).isNotNull() & (F.col(c) != ""), F.struct("at", F.col(c).alias("v"))))), lambda s: s["v"]))

    k = F.col("kind")
    gender = F.create_map(*[F.lit(x) for kv in GENDER.items() for x in kv])
    per_profile = feats.groupBy("pid").agg(
        gathered(k == FEATURE["dob"], "born").alias("dob"), gathered(k == FEATURE["pob"], "place").alias("pob"), gathered(k.isin(FEATURE["nationality"], FEATURE["citizenship"]), "area").alias("nationality"),
        gathered(k == FEATURE["address"], "place").alias("addresses"), F.max(F.when(k == FEATURE["gender"], F.element_at(gender, F.col("code")))).alias("gender"),
    )
    docs = xml(spark, path, "IDRegDocument", "_IdentityID string, IDRegDocType string, IDRegistrationNo string, IssuingCountry string").filter(t("IDRegistrationNo") != "")
    docs = docs.groupBy(F.col("_IdentityID").alias("identity")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.nullif(t("IDRegDocType"), F.lit("")), F.lit("Unknown")).alias("type"), t("IDRegistrationNo").alias("value"), t("IssuingCountry").alias("country")))).alias("identifiers"))
    ent = xml(spark, path, "SanctionsEntry", f"_ProfileID string, EntryEvent array<struct<Date:{_DATE}>>, SanctionsMeasure array<struct<_SanctionsTypeID:string,Comment:string>>")
    kinds = _reference(spark, path, "SanctionsType")
    prog = ent.select(F.col("_ProfileID").alias("pid"), F.explode_outer("SanctionsMeasure").alias("m"), F.get(F.col("EntryEvent"), F.lit(0))["Date"].alias("d")).join(kinds.select(F.col("id").alias("st"), F.lower("value").alias("kind")), F.col("m._SanctionsTypeID") == F.col("st"), "left")
    prog = prog.groupBy("pid").agg(
        F.array_sort(F.collect_set(F.when(F.coalesce("kind", F.lit("program")) == "program", F.nullif(t("m.Comment"), F.lit(""))))).alias("programs"), F.min(date_parts(F.col("d.Year"), F.col("d.Month"), F.col("d.Day"))).alias("listed_on"),
    )
    full = base.join(per_profile, "pid", "left").join(docs, "identity", "left").join(prog, "pid", "left")
    return entries(
        full, id=F.concat(F.lit("ofac-"), F.col("ref")), source=F.lit(source), list_name=F.lit("OFAC SDN List" if source == "ofac_sdn" else "OFAC Consolidated List"), names=F.col("nm")["n"], alias_quality=F.col("nm")["q"],
        dob=listed("dob"), dob_approximate=F.exists(listed("dob"), lambda d: F.length(d) < 10), pob=listed("pob"), nationality=listed("nationality"), gender=F.col("gender"), addresses=listed("addresses"),
        identifiers=listed("identifiers"), programs=listed("programs"), listed_on=F.col("listed_on"),
    )
