"""Readers of the lists published as XML: UN, EU, UK, Canada, Switzerland, European Parliament."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import registry_date
from .common import canonical_gender, distinct_names, entries, joined, listed, name, none_if_blank, some, t, texts, xml


def read_un(spark: SparkSession, path: str) -> DataFrame:
    birth = "struct<TYPE_OF_DATE:string,DATE:string,YEAR:string,FROM_YEAR:string,TO_YEAR:string>"
    place = "struct<STREET:string,CITY:string,STATE_PROVINCE:string,COUNTRY:string>"
    df = xml(spark, path, "INDIVIDUAL", f"""REFERENCE_NUMBER string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, NAME_ORIGINAL_SCRIPT string,
        INDIVIDUAL_ALIAS array<struct<QUALITY:string,ALIAS_NAME:string>>, INDIVIDUAL_DATE_OF_BIRTH array<{birth}>, INDIVIDUAL_PLACE_OF_BIRTH array<{place}>,
        NATIONALITY struct<VALUE:array<string>>, INDIVIDUAL_DOCUMENT array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string>>, INDIVIDUAL_ADDRESS array<{place}>,
        GENDER string, DESIGNATION struct<VALUE:array<string>>, COMMENTS1 string, LISTED_ON string, UN_LIST_TYPE string""")  # fmt: skip
    full = joined(*[t(f"{n}_NAME") for n in ("FIRST", "SECOND", "THIRD", "FOURTH")])
    alias = F.transform(listed("INDIVIDUAL_ALIAS"), lambda a: name(t(a["ALIAS_NAME"]), F.when(t(a["QUALITY"]) == "Good", "strong").when(t(a["QUALITY"]) == "Low", "weak").otherwise("unknown")))
    every = F.filter(F.concat(F.array(name(full, "strong"), name(t("NAME_ORIGINAL_SCRIPT"), "strong")), alias), lambda p: p["n"] != "")
    births = listed("INDIVIDUAL_DATE_OF_BIRTH")

    def birth_text(b: Column) -> Column:
        span = F.when((t(b["FROM_YEAR"]) != "") & (t(b["TO_YEAR"]) != ""), F.concat(t(b["FROM_YEAR"]), F.lit("-"), t(b["TO_YEAR"]))).otherwise(t(b["FROM_YEAR"]))
        return F.when(t(b["DATE"]) != "", t(b["DATE"])).when(t(b["YEAR"]) != "", t(b["YEAR"])).otherwise(span)

    def place_text(p: Column, *parts: str) -> Column:
        return joined(*[t(p[x]) for x in parts], sep=", ")

    return entries(
        df.filter(full != ""),
        id=F.concat(F.lit("un-"), F.when(t("REFERENCE_NUMBER") != "", t("REFERENCE_NUMBER")).otherwise(full)), source=F.lit("un_consolidated"), list_name=F.lit("UN Security Council Consolidated List"),
        names=every["n"], alias_quality=every["q"], dob=F.filter(F.transform(births, birth_text), lambda x: x != ""),
        dob_approximate=F.exists(births, lambda b: t(b["TYPE_OF_DATE"]).isin("APPROXIMATELY", "BETWEEN")),
        pob=F.filter(F.transform(listed("INDIVIDUAL_PLACE_OF_BIRTH"), lambda p: place_text(p, "CITY", "STATE_PROVINCE", "COUNTRY")), lambda x: x != ""),
        nationality=texts("NATIONALITY.VALUE"),
        identifiers=F.transform(listed("INDIVIDUAL_DOCUMENT"), lambda d: F.struct(t(d["TYPE_OF_DOCUMENT"]).alias("type"), t(d["NUMBER"]).alias("value"), t(d["ISSUING_COUNTRY"]).alias("country"))),
        addresses=F.filter(F.transform(listed("INDIVIDUAL_ADDRESS"), lambda p: place_text(p, "STREET", "CITY", "STATE_PROVINCE", "COUNTRY")), lambda x: x != ""),
        gender=canonical_gender(F.col("GENDER")), designation=none_if_blank(F.array_join(texts("DESIGNATION.VALUE"), "; ")), listing_reason=none_if_blank(t("COMMENTS1")),
        listed_on=none_if_blank(t("LISTED_ON")), programs=some(t("UN_LIST_TYPE")),
    )


def read_eu(spark: SparkSession, path: str) -> DataFrame:
    alias = "struct<_wholeName:string,_firstName:string,_middleName:string,_lastName:string,_nameLanguage:string,_strong:string,_gender:string,_function:string>"
    df = xml(spark, path, "sanctionEntity", f"""_euReferenceNumber string, _designationDate string, subjectType struct<_code:string,_classificationCode:string>, remark array<string>,
        regulation array<struct<_programme:string,_publicationDate:string>>, nameAlias array<{alias}>, birthdate array<struct<_birthdate:string,_year:string,_circa:string,_city:string,_countryIso2Code:string>>,
        citizenship array<struct<_countryIso2Code:string,_countryDescription:string>>, identification array<struct<_identificationTypeCode:string,_number:string,_countryIso2Code:string>>,
        address array<struct<_street:string,_city:string,_zipCode:string,_countryIso2Code:string>>""")  # fmt: skip
    df = df.filter((F.col("subjectType._code") == "person") & (F.col("subjectType._classificationCode") == "P"))

    def alias_name(a: Column) -> Column:
        parts = joined(t(a["_firstName"]), t(a["_middleName"]), t(a["_lastName"]))
        return F.when(t(a["_wholeName"]) != "", t(a["_wholeName"])).otherwise(parts)

    al = listed("nameAlias")
    english = lambda a: t(a["_nameLanguage"]) == "EN"
    strong = lambda a: F.lower(t(a["_strong"])) == "true"
    ranked = F.concat(
        F.transform(F.filter(al, english), lambda a: name(alias_name(a), "strong")),
        F.transform(F.filter(al, lambda a: ~english(a) & strong(a)), lambda a: name(alias_name(a), "strong")),
        F.transform(F.filter(al, lambda a: ~english(a) & ~strong(a)), lambda a: name(alias_name(a), "weak")),
    )
    every = distinct_names(ranked)
    born = listed("birthdate")
    genders = F.filter(F.transform(al, lambda a: t(a["_gender"])), lambda g: g != "")
    return entries(
        df,
        id=F.concat(F.lit("eu-"), t("_euReferenceNumber")), source=F.lit("eu_fsf"), list_name=F.lit("EU Financial Sanctions"), names=every["n"], alias_quality=every["q"],
        dob=F.filter(F.transform(born, lambda b: F.when(t(b["_birthdate"]) != "", t(b["_birthdate"])).otherwise(t(b["_year"]))), lambda x: x != ""),
        dob_approximate=F.exists(born, lambda b: F.lower(t(b["_circa"])) == "true"),
        pob=F.filter(F.transform(born, lambda b: joined(t(b["_city"]), t(b["_countryIso2Code"]), sep=", ")), lambda x: x != ""),
        nationality=F.filter(F.transform(listed("citizenship"), lambda c: F.when(t(c["_countryIso2Code"]) != "", t(c["_countryIso2Code"])).otherwise(t(c["_countryDescription"]))), lambda x: x != ""),
        gender=canonical_gender(F.get(genders, F.lit(0))),
        identifiers=F.transform(listed("identification"), lambda d: F.struct(t(d["_identificationTypeCode"]).alias("type"), t(d["_number"]).alias("value"), t(d["_countryIso2Code"]).alias("country"))),
        addresses=F.filter(F.transform(listed("address"), lambda p: joined(t(p["_street"]), t(p["_city"]), t(p["_zipCode"]), t(p["_countryIso2Code"]), sep=", ")), lambda x: x != ""),
        designation=none_if_blank(F.array_join(F.filter(F.transform(al, lambda a: t(a["_function"])), lambda x: x != ""), "; ")), listing_reason=none_if_blank(F.array_join(texts("remark"), "; ")),
        listed_on=none_if_blank(t("_designationDate")), programs=F.array_distinct(F.filter(F.transform(listed("regulation"), lambda r: t(r["_programme"])), lambda x: x != "")),
    )


def read_uk(spark: SparkSession, path: str) -> DataFrame:
    one = "struct<Name1:string,Name2:string,Name3:string,Name4:string,Name5:string,Name6:string,NameType:string,AliasStrength:string>"
    detail = """struct<DOBs:struct<DOB:array<string>>,Nationalities:struct<Nationality:array<string>>,Positions:struct<Position:array<string>>,Genders:struct<Gender:array<string>>,
        PassportDetails:struct<Passport:array<struct<PassportNumber:string,PassportCountry:string>>>,BirthDetails:struct<Location:array<struct<TownOfBirth:string,CountryOfBirth:string>>>,
        IndividualDateOfBirth:array<struct<DateOfBirth:string,Year:string>>>"""  # fmt: skip
    df = xml(spark, path, "Designation", f"""UniqueID string, IndividualEntityShip string, RegimeName string, OtherInformation string, DateListed string, DateDesignated string, Gender string, Position string,
        Names struct<Name:array<{one}>>, Addresses struct<Address:array<struct<AddressLine1:string,AddressLine2:string,AddressLine3:string,AddressPostalCode:string,AddressCountry:string>>>,
        IndividualDetails struct<Individual:{detail}>""").filter(t("IndividualEntityShip") == "Individual")  # fmt: skip

    def quality(n: Column) -> Column:
        strength = F.lower(t(n["AliasStrength"]))
        alias = F.when(strength == "good quality", "strong").when(strength == "low quality", "weak").otherwise("unknown")
        return F.when(t(n["NameType"]).isin("Primary Name", "Primary Name Variation"), "strong").when(t(n["NameType"]) == "Alias", alias).otherwise("unknown")

    every = distinct_names(F.transform(listed("Names.Name"), lambda n: name(joined(*[t(n[f"Name{i}"]) for i in range(1, 7)]), quality(n))))
    d = F.col("IndividualDetails.Individual")
    born = listed(d["IndividualDateOfBirth"])
    dated = F.transform(born, lambda b: F.when(t(b["DateOfBirth"]) != "", t(b["DateOfBirth"])).otherwise(t(b["Year"])))
    places = listed(d["BirthDetails"]["Location"])
    return entries(
        df,
        id=F.concat(F.lit("uk-"), F.when(t("UniqueID") != "", t("UniqueID")).otherwise(F.get(every["n"], F.lit(0)))), source=F.lit("uk_sanctions"), list_name=F.lit("UK Sanctions List"),
        names=every["n"], alias_quality=every["q"], dob=F.concat(F.filter(dated, lambda x: x != ""), texts(d["DOBs"]["DOB"])),
        dob_approximate=F.exists(born, lambda b: (t(b["DateOfBirth"]) == "") & (t(b["Year"]) != "")),
        nationality=texts(d["Nationalities"]["Nationality"]), gender=canonical_gender(F.coalesce(F.col("Gender"), F.get(listed(d["Genders"]["Gender"]), F.lit(0)))),
        pob=F.array_distinct(F.concat(F.filter(F.transform(places, lambda p: t(p["TownOfBirth"])), lambda x: x != ""), F.filter(F.transform(places, lambda p: t(p["CountryOfBirth"])), lambda x: x != ""))),
        identifiers=F.filter(F.transform(listed(d["PassportDetails"]["Passport"]), lambda p: F.struct(F.lit("passport").alias("type"), t(p["PassportNumber"]).alias("value"), t(p["PassportCountry"]).alias("country"))), lambda i: i["value"] != ""),
        addresses=F.filter(F.transform(listed("Addresses.Address"), lambda a: joined(*[t(a[x]) for x in ("AddressLine1", "AddressLine2", "AddressLine3", "AddressPostalCode", "AddressCountry")], sep=", ")), lambda x: x != ""),
        designation=none_if_blank(F.coalesce(none_if_blank(t("Position")), F.array_join(texts(d["Positions"]["Position"]), "; "))), listing_reason=none_if_blank(t("OtherInformation")),
        listed_on=F.coalesce(none_if_blank(t("DateListed")), none_if_blank(t("DateDesignated"))), programs=some(t("RegimeName")),
    )


def read_canada(spark: SparkSession, path: str) -> DataFrame:
    df = xml(spark, path, "record", "GivenName string, LastName string, DateOfBirth string, Aliases string, Country string, Schedule string, Item string")
    full = joined(t("GivenName"), t("LastName"))
    tagged = r"^[A-Za-z]+:\s*(.+)$"
    fields = F.filter(F.array(t("GivenName"), t("LastName")), lambda x: x.rlike(tagged))
    own = F.transform(fields, lambda x: name(F.regexp_extract(x, tagged, 1), "weak"))
    parts = F.filter(F.transform(F.split(t("Aliases"), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    extra = F.flatten(F.transform(parts, lambda x: F.when(x.rlike(tagged), F.array(name(F.regexp_extract(x, tagged, 1), "weak"), name(x, "weak"))).otherwise(F.array(name(x, "unknown")))))
    rest = F.filter(F.concat(own, extra), lambda p: (p["n"] != "") & (F.lower(p["n"]) != F.lower(full)))
    every = F.concat(F.array(name(full, "strong")), rest)
    born = registry_date(t("DateOfBirth"))
    ident = F.when(t("LastName") != "", F.replace(F.concat(t("LastName"), F.lit("-"), t("GivenName")), F.lit(" "), F.lit("_"))).otherwise(full)
    return entries(
        df.filter(full != ""), id=F.concat(F.lit("ca-"), ident), source=F.lit("ca_sema"), list_name=F.lit("Canada SEMA"), names=every["n"], alias_quality=every["q"],
        dob=F.array_compact(F.array(born)), nationality=some(F.trim(F.split_part(t("Country"), F.lit(" / "), F.lit(1)))),
        programs=some(t("Schedule"), F.when(t("Item") != "", F.concat(F.lit("Item "), t("Item"))).otherwise(F.lit(""))),
    )


# The feed's kinds of name parts; given and father's names come before family names.
_LAST_PARTS = ("family-name", "maiden-name", "tribal-name")


def read_switzerland(spark: SparkSession, path: str) -> DataFrame:
    part = "struct<`_name-part-type`:string,value:string>"
    ident = f"struct<_main:string,name:array<struct<`name-part`:array<{part}>>>,`day-month-year`:array<struct<_day:string,_month:string,_year:string>>,nationality:array<struct<country:string>>,`identification-document`:array<struct<`_document-type`:string,number:string,issuer:string>>>"
    df = xml(spark, path, "target", f"_ssid string, `_modification-type` string, `sanctions-program` array<string>, `foreign-identifier` string, individual struct<_sex:string,identity:array<{ident}>,justification:string,`other-information`:string>")
    df = df.filter(F.col("individual").isNotNull() & (F.coalesce(F.col("_modification-type"), F.lit("")) != "de-listed"))

    def person_name(n: Column) -> Column:
        ps = F.filter(listed(n["name-part"]), lambda p: t(p["value"]) != "")
        kind = lambda p: t(p["_name-part-type"])
        whole = F.filter(ps, lambda p: kind(p) == "whole-name")
        first = F.transform(F.filter(ps, lambda p: ~kind(p).isin(*_LAST_PARTS)), lambda p: t(p["value"]))
        last = F.transform(F.filter(ps, lambda p: kind(p).isin(*_LAST_PARTS)), lambda p: t(p["value"]))
        return F.when(F.size(whole) > 0, t(F.get(whole, F.lit(0))["value"])).otherwise(F.array_join(F.concat(first, last), " "))

    ids = listed("individual.identity")
    every = distinct_names(F.flatten(F.transform(ids, lambda i: F.transform(listed(i["name"]), lambda n: name(person_name(n), F.when(F.lower(t(i["_main"])) == "true", "strong").otherwise("weak"))))))
    from ..functions.dates import date_parts

    born = F.flatten(F.transform(ids, lambda i: F.transform(listed(i["day-month-year"]), lambda d: date_parts(d["_year"], d["_month"], d["_day"]))))
    docs = F.flatten(F.transform(ids, lambda i: F.transform(listed(i["identification-document"]), lambda d: F.struct(t(d["_document-type"]).alias("type"), t(d["number"]).alias("value"), t(d["issuer"]).alias("country")))))
    return entries(
        df, id=F.concat(F.lit("ch-"), t("_ssid")), source=F.lit("ch_seco"), list_name=F.lit("Switzerland SECO"), names=every["n"], alias_quality=every["q"], dob=F.array_compact(born),
        nationality=F.array_distinct(F.flatten(F.transform(ids, lambda i: F.filter(F.transform(listed(i["nationality"]), lambda x: t(x["country"])), lambda x: x != "")))),
        identifiers=F.filter(docs, lambda d: d["value"] != ""), gender=canonical_gender(F.col("individual._sex")), listing_reason=none_if_blank(t("individual.justification")),
        designation=none_if_blank(t("individual.other-information")), programs=F.array_distinct(texts("sanctions-program")),
    )


def read_eu_parliament(spark: SparkSession, path: str) -> DataFrame:
    df = xml(spark, path, "mep", "fullName string, id string, country string, politicalGroup string")
    full = t("fullName")
    return entries(
        df.filter(full != ""), id=F.concat(F.lit("eup-"), F.when(t("id") != "", t("id")).otherwise(F.replace(full, F.lit(" "), F.lit("_")))), source=F.lit("eu_parliament"),
        list_name=F.lit("European Parliament (Current MEPs)"), names=F.array(full), alias_quality=F.array(F.lit("strong")), nationality=some(t("country")), designation=none_if_blank(t("politicalGroup")),
    )
