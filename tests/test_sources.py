import json

from watchloom.operators.report import workbook
from watchloom.sources import api_feeds, ofac, registry, xml_feeds
from watchloom.sources.common import ENTRY


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)
    return str(p)


def only(df):
    assert df.columns == list(ENTRY)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_un(spark, tmp_path):
    p = put(tmp_path, "un.xml", """<L><INDIVIDUALS><INDIVIDUAL><FIRST_NAME>ALI</FIRST_NAME><SECOND_NAME>KHAN</SECOND_NAME><REFERENCE_NUMBER>QDi.1</REFERENCE_NUMBER>
      <INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>A K</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>BETWEEN</TYPE_OF_DATE><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1962</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH>
      <NATIONALITY><VALUE>Iraq</VALUE></NATIONALITY><LISTED_ON>2001-01-01</LISTED_ON><UN_LIST_TYPE>Al-Qaida</UN_LIST_TYPE></INDIVIDUAL><INDIVIDUAL><REFERENCE_NUMBER>x</REFERENCE_NUMBER></INDIVIDUAL></INDIVIDUALS></L>""")  # fmt: skip
    r = only(xml_feeds.read_un(spark, p))
    assert (r["id"], r["names"], r["alias_quality"], r["dob"], r["dob_approximate"], r["nationality"]) == ("un-QDi.1", ["ALI KHAN", "A K"], ["strong", "weak"], ["1960-1962"], True, ["Iraq"])


def test_eu(spark, tmp_path):
    p = put(tmp_path, "eu.xml", """<n:export xmlns:n="urn:x"><n:sanctionEntity euReferenceNumber="EU.1.2"><n:subjectType code="person" classificationCode="P"/><n:nameAlias wholeName="Weak One" nameLanguage="FR" strong="false"/>
      <n:nameAlias firstName="Omar" lastName="X" nameLanguage="EN" strong="true" gender="M"/><n:nameAlias wholeName="omar x" nameLanguage="DE" strong="true"/><n:birthdate year="1970" circa="true" city="Aden" countryIso2Code="YE"/></n:sanctionEntity>
      <n:sanctionEntity euReferenceNumber="EU.3"><n:subjectType code="enterprise" classificationCode="E"/><n:nameAlias wholeName="Co"/></n:sanctionEntity></n:export>""")  # fmt: skip
    r = only(xml_feeds.read_eu(spark, p))
    assert (r["names"], r["alias_quality"], r["gender"], r["dob"], r["pob"]) == (["Omar X", "Weak One"], ["strong", "weak"], "male", ["1970"], ["Aden, YE"])


def test_uk(spark, tmp_path):
    p = put(tmp_path, "uk.xml", """<D><Designation><UniqueID>R1</UniqueID><IndividualEntityShip>Individual</IndividualEntityShip><RegimeName>Reg</RegimeName><Names><Name><Name1>Jo</Name1><Name6>Bloggs</Name6><NameType>Primary Name</NameType></Name>
      <Name><Name6>BLOGGS</Name6><NameType>Alias</NameType><AliasStrength>Low Quality</AliasStrength></Name></Names><IndividualDetails><Individual><DOBs><DOB>dd/mm/1970</DOB></DOBs><Nationalities><Nationality>Iran</Nationality></Nationalities></Individual></IndividualDetails></Designation>
      <Designation><UniqueID>R2</UniqueID><IndividualEntityShip>Ship</IndividualEntityShip></Designation></D>""")  # fmt: skip
    r = only(xml_feeds.read_uk(spark, p))
    assert (r["id"], r["names"], r["alias_quality"], r["dob"], r["programs"]) == ("uk-R1", ["Jo Bloggs", "BLOGGS"], ["strong", "weak"], ["dd/mm/1970"], ["Reg"])


def test_canada(spark, tmp_path):
    p = put(tmp_path, "ca.xml", "<d><record><Country>Russia / Russie</Country><LastName>Petrov</LastName><GivenName>Oleg</GivenName><DateOfBirth>1970-01-02</DateOfBirth><Aliases>Russian: Олег; O P</Aliases><Schedule>1</Schedule><Item>7</Item></record><record><Country>X</Country></record></d>")
    r = only(xml_feeds.read_canada(spark, p))
    assert (r["id"], r["names"], r["nationality"], r["dob"], r["programs"], r["source"]) == ("ca-Petrov-Oleg", ["Oleg Petrov", "Олег", "Russian: Олег", "O P"], ["Russia"], ["1970-01-02"], ["1", "Item 7"], "ca_sema")


def test_switzerland(spark, tmp_path):
    p = put(tmp_path, "ch.xml", """<s><target ssid="9"><individual sex="female"><identity main="true"><name><name-part name-part-type="family-name"><value>Doe</value></name-part><name-part name-part-type="given-name"><value>Ann</value></name-part></name>
      <day-month-year day="2" month="3" year="1970"/><nationality><country>IR</country></nationality></identity><justification>why</justification></individual></target><target ssid="8" modification-type="de-listed"><individual/></target></s>""")  # fmt: skip
    r = only(xml_feeds.read_switzerland(spark, p))
    assert (r["id"], r["names"], r["dob"], r["gender"], r["nationality"]) == ("ch-9", ["Ann Doe"], ["1970-03-02"], "female", ["IR"])


def test_ofac(spark, tmp_path):
    p = put(tmp_path, "ofac.xml", """<Sanctions><ReferenceValueSets><PartyTypeValues><PartyType ID="1">Individual</PartyType><PartyType ID="2">Entity</PartyType></PartyTypeValues><PartySubTypeValues><PartySubType ID="4" PartyTypeID="1">x</PartySubType><PartySubType ID="3" PartyTypeID="2">y</PartySubType></PartySubTypeValues>
      <AreaCodeValues><AreaCode ID="100">Cuba</AreaCode></AreaCodeValues><CountryValues><Country ID="11">Iran</Country></CountryValues><SanctionsTypeValues><SanctionsType ID="1">Program</SanctionsType></SanctionsTypeValues></ReferenceValueSets>
      <Locations><Location ID="77"><LocationCountry CountryID="11"/><LocationPart><LocationPartValue><Value>Tehran</Value></LocationPartValue></LocationPart></Location></Locations>
      <IDRegDocuments><IDRegDocument IdentityID="5"><IDRegDocType>Passport</IDRegDocType><IDRegistrationNo>A1</IDRegistrationNo><IssuingCountry>IR</IssuingCountry></IDRegDocument></IDRegDocuments>
      <DistinctParties><DistinctParty FixedRef="36"><Profile ID="36" PartySubTypeID="4"><Identity ID="5"><Alias Primary="true" LowQuality="false"><DocumentedName><DocumentedNamePart><NamePartValue NamePartGroupID="1" ScriptID="215">DOE</NamePartValue></DocumentedNamePart><DocumentedNamePart><NamePartValue NamePartGroupID="2" ScriptID="215">Jane</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
      <NamePartGroups><MasterNamePartGroup><NamePartGroup ID="1" NamePartTypeID="1520"/></MasterNamePartGroup><MasterNamePartGroup><NamePartGroup ID="2" NamePartTypeID="1521"/></MasterNamePartGroup></NamePartGroups></Identity>
      <Feature FeatureTypeID="8"><FeatureVersion><DatePeriod><Start><From><Year>1970</Year><Month>1</Month><Day>1</Day></From></Start><End><To><Year>1970</Year><Month>12</Month><Day>31</Day></To></End></DatePeriod></FeatureVersion></Feature>
      <Feature FeatureTypeID="9"><FeatureVersion><VersionLocation LocationID="77"/></FeatureVersion></Feature><Feature FeatureTypeID="10"><FeatureVersion><VersionDetail DetailReferenceID="100"/></FeatureVersion></Feature></Profile></DistinctParty>
      <DistinctParty FixedRef="37"><Profile ID="37" PartySubTypeID="3"><Identity ID="6"/></Profile></DistinctParty></DistinctParties>
      <SanctionsEntries><SanctionsEntry ProfileID="36"><EntryEvent><Date><Year>2001</Year><Month>2</Month><Day>3</Day></Date></EntryEvent><SanctionsMeasure SanctionsTypeID="1"><Comment>SDGT</Comment></SanctionsMeasure></SanctionsEntry></SanctionsEntries></Sanctions>""")  # fmt: skip
    r = only(ofac.read_ofac(spark, p))
    assert (r["id"], r["names"], r["dob"], r["pob"], r["nationality"], r["programs"], r["listed_on"]) == ("ofac-36", ["Jane DOE"], ["1970"], ["Tehran, Iran"], ["Cuba"], ["SDGT"], "2001-02-03")
    assert [(i["type"], i["value"]) for i in r["identifiers"]] == [("Passport", "A1")]


def test_json_feeds(spark, tmp_path):
    b = {"person": {"value": "http://x/Q1"}, "personLabel": {"value": "Ann"}, "positionLabel": {"value": "Minister"}, "startDate": {"value": "2010-01-01T00"}}
    put(tmp_path, "wd/country=PK/a.json", json.dumps({"results": {"bindings": [b, b, {"person": {"value": "http://x/Q2"}, "personLabel": {"value": "Q2"}}]}}))
    r = only(api_feeds.read_wikidata(spark, str(tmp_path / "wd")))
    assert (r["id"], r["listed_on"], r["nationality"]) == ("wd-Q1", "2010-01-01", ["PK"])
    p = put(tmp_path, "us.json", json.dumps([{"id": {"bioguide": "B1"}, "name": {"first": "A", "last": "B"}, "bio": {"gender": "F", "birthday": "1960-01-01"}, "terms": [{"type": "rep", "state": "TX", "party": "D"}, {"type": "sen", "state": "NY", "party": "R"}]}]))
    r = only(api_feeds.read_congress(spark, p))
    assert (r["id"], r["designation"], r["gender"]) == ("usc-B1", "SEN - NY (R)", "female")
    p = put(tmp_path, "ukp.json", json.dumps({"items": [{"value": {"id": 5, "nameDisplayAs": "C D", "gender": "Male", "latestHouseMembership": {"house": 1, "membershipFrom": "Leeds"}}}]}))
    assert only(api_feeds.read_uk_parliament(spark, p))["designation"] == "House of Commons - Leeds"
    p = put(tmp_path, "fbi.json", json.dumps({"items": [{"uid": "u", "title": "E F", "aliases": ["E F", "Eff"], "dates_of_birth_used": ["May 1, 1970"], "nationality": "A, B", "sex": "Male"}]}))
    r = only(api_feeds.read_fbi(spark, p))
    assert (r["names"], r["nationality"]) == (["E F", "Eff"], ["A", "B"])
    p = put(tmp_path, "mep.xml", "<meps><mep><fullName>G H</fullName><country>France</country><politicalGroup>PG</politicalGroup><id>3</id></mep></meps>")
    assert only(xml_feeds.read_eu_parliament(spark, p))["id"] == "eup-3"


def test_australia(spark, tmp_path):
    p = put(tmp_path, "au.xlsx", workbook({"S": [["Reference", "Name of Individual or Entity", "Date of Birth", "Citizenship"], ["101", "I J", "circa 1960", "X"], ["101a", "I Jay", "1/2/1960", ""], ["102", "", "", ""]]}))
    r = only(api_feeds.read_australia(spark, p))
    assert (r["id"], r["names"], r["dob"], r["dob_approximate"]) == ("au-101", ["I J", "I Jay"], ["~1960", "1960-02-01"], True)


def test_union_of_feeds(spark, tmp_path):
    p = put(tmp_path, "mep.xml", "<meps><mep><fullName>Gülay Őz</fullName><id>3</id></mep></meps>")
    df, failed = registry.read_all(spark, {"eu_parliament": p, "fbi_wanted": str(tmp_path / "missing.json")})
    assert set(failed) == {"fbi_wanted"}
    flat = registry.flat_table(df).first()
    assert (flat["name_ascii"], flat["phonetic_primary"]) == ("Gulay Oz", "KL OS")


def test_subjects_csv(spark, tmp_path):
    p = put(tmp_path, "s.csv", "name,dob\n Ann ,1970\n,1\n")
    assert [(r["name"], r["dob"], r["cnic"]) for r in api_feeds.read_subjects(spark, p).collect()] == [("Ann", "1970", "")]


def test_paged_json_and_sql_functions(spark, tmp_path):
    import json

    from watchloom.functions import text
    from watchloom.functions.registry import register
    from watchloom.session import ship

    ship(spark)
    names = register(spark)
    for i in range(3):
        (tmp_path / f"p{i * 2}.json").write_text(json.dumps({"total": 5, "items": [{"n": j} for j in range(i * 2, min(5, i * 2 + 2))] + [None]}))
    pages = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{offset}}.json").option("size", "2").load()
    assert sorted(json.loads(r["item"])["n"] for r in pages.collect()) == list(range(5))
    assert {"tokens", "normalize_name", "birth_years", "lcs_ratio"} <= set(names)
    got = spark.sql("SELECT normalize_name('Dr. José  O\\'Neil-Al (x)') AS n, birth_years('1970-01-02|circa 1980|1990') AS y, lcs_ratio('abc', 'abd') AS r").first()
    df = spark.createDataFrame([("Dr. José  O'Neil-Al (x)",)], "t string")
    assert got["n"] == df.select(text.normalize_name("t")).first()[0] and list(got["y"]) == [1970, 1990] and abs(got["r"] - 66.6666) < 0.001
    assert [tuple(r) for r in spark.sql("SELECT * FROM tokens('Ébène, x-Y')").collect()] == [("ebene", 0), ("x", 1), ("y", 2)]


def test_refresh_with_a_failing_feed(spark, tmp_path):
    from datetime import datetime

    from watchloom.operators import store
    from watchloom.session import ship
    from watchloom.sources.refresh import refresh

    ship(spark)
    mep = lambda i, n: f"<mep><id>{i}</id><fullName>{n}</fullName><country>France</country><politicalGroup>g</politicalGroup></mep>"
    (tmp_path / "m.xml").write_text("<meps>" + mep(1, "Ana B") + mep(2, "Cy D") + "</meps>")
    live = store.SnapshotStore(spark, "file://" + str(tmp_path / "w"))
    version, meta = refresh(spark, {"eu_parliament": str(tmp_path / "m.xml"), "un_consolidated": str(tmp_path / "gone.xml")}, live, at=datetime(2026, 1, 1))
    got = {r["source"]: (r["status"], r["entity_count"], r["quality"], bool(r["file_hash"])) for r in meta.collect()}
    assert version and got == {"eu_parliament": ("ok", 2, "low", True), "un_consolidated": ("error", 0, None, False)} and live.current().count() == 2
    again, meta = refresh(spark, {"eu_parliament": str(tmp_path / "gone.xml")}, live, meta, at=datetime(2026, 1, 2))
    assert again is None and live.current().count() == 2 and {r["source"]: r["status"] for r in meta.collect()} == {"eu_parliament": "error", "un_consolidated": "error"}
    h = store.file_hashes(spark, str(tmp_path / "m.xml")).first()
    import hashlib

    assert h["file_hash"] == hashlib.sha256((tmp_path / "m.xml").read_bytes()).hexdigest()
