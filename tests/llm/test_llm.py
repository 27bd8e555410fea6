"""Operators of the optional subpackage against brute force, round trips and labelled rows."""

import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom.llm import attributes as A
from watchloom.llm import components, entity_match, lookalikes, name_variants, names, packing, queries, survivors, tokenizer, truncation

ENT = "id string, source string, name string, name_latin string, aliases string, dob string, nationality string, identifiers string, gender string, designation string, listed_on string"
DIR = "/root/testdata/sf0.01"


def ent(spark, rows):
    base = dict(source="un", name=None, name_latin=None, aliases=None, dob=None, nationality=None, identifiers=None, gender=None, designation=None, listed_on=None)
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in ENT.split(", ")) for r in rows], ENT)


# --- kernels -------------------------------------------------------------------------------------


@given(st.text(alphabet="abcd", max_size=8), st.text(alphabet="abcd", max_size=8))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b):
    d = {}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i < 0 or j < 0:
                d[i, j] = max(i, j) + 1
            else:
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    want = d[len(a) - 1, len(b) - 1]
    assert names.osa(a, b, 3) == min(want, 4)


@pytest.mark.parametrize(
    "text,rank", [("1970-01-02", 4), ("02/01/1970", 4), ("Jan 2, 1970", 4), ("2 Jan 1970", 4), ("1970-01", 3), ("Jan 1970", 3), ("circa 1970", 2), ("1970", 2), ("between 1960 and 1965", 1), ("1960 to 1965", 1), ("unknown", None), ("00/00/0000", None), ("", None)]
)
def test_dates(text, rank):
    d = A.read_date(text)
    assert (d[0] if d else None) == rank


def test_date_slips():
    full = A.read_date
    assert A.date_pair(full("1970-03-04"), full("04/03/1970")) == 3
    assert A.date_pair(full("1970-03-04"), full("1970-04-03")) == 1 and A.date_pair(full("1970-03-04"), full("1971-03-04")) == 1
    assert A.date_pair(full("1970-03-04"), full("1980-03-04")) == 0 and A.date_pair(full("1970-03-04"), full("1970")) == 2


def test_readers_are_total():
    for x in (None, "", "  ", "-", "|||", "{broken", "[1, 2]", "x" * 100_000):
        assert isinstance(A.dates(x), list) and isinstance(A.countries(x), list) and isinstance(A.numbers(x), list) and isinstance(names.tokens(x), list)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("GOMSOLOPAK, Maksim", "Dr. Maxim Gomsolopak", True), ("Максим Гомсолопак", "Maksim Gomsolopak", True), ("Abd al-Rahman el-Bubmoudi", "ELBUBMOUDI, Abdurrahman", True),
        ("Jean‑Pierre Talbolba", "TALBOLBA Jeanpierre", True), ("Tolya Rilradazoff", "Anatoly Rilradazov", True), ("J. Feningpockby", "James Feningpockby", True),
        ("Tariq Hamzoudiran", "Saleem Hamzoudiran", False), ("Sergei Ivan Pevborakenko", "Ivan Pevborakenko", False), ("", "Ivan", False),
    ],
)
def test_name_pairs(a, b, same):
    assert (names.name_match(tuple(names.tokens(a)), tuple(names.tokens(b))) >= 0.8) is same


# --- groups and survivors ------------------------------------------------------------------------


def brute_groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"l{i:02}") for i in range(40)] + [(f"r{rng.randrange(80):02}", f"r{rng.randrange(80):02}") for _ in range(60)]
    df = spark.createDataFrame(edges + edges[:5] + [("x", "x"), (None, "y"), ("", "z")], "a string, b string")
    got = {r["id"]: r["group_id"] for r in components.components(df).collect()}
    assert got == brute_groups([(a, b) for a, b in edges if a != b])
    assert components.components(df.limit(0)).count() == 0


def test_latest_decision_counts(spark):
    pairs = spark.createDataFrame([("a", "b", "2020", True), ("b", "a", "2021", False), ("a", "c", "2020", True), ("c", "gone", "2020", True), ("c", "c", "2020", True), (None, "a", "2020", True)], "id_a string, id_b string, t string, merged boolean")
    pairs = pairs.withColumn("decided_at", F.to_timestamp("t", "yyyy")).drop("t")
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")
    assert [tuple(r) for r in components.merged_edges(pairs, e).collect()] == [("a", "c")]


def test_survivors_follow_the_order(spark):
    e = ent(spark, [
        dict(id="a", source="hi", dob="circa 1970", nationality="IR|Iran", designation=" Mayor ", listed_on="2001-01-01"), dict(id="b", source="lo", dob="1970-01-02", nationality="IQ", designation="n/a", listed_on="2 Jan 2002"),
        dict(id="c", source="lo", dob="02/01/1970", nationality="unknown", listed_on="03/01/2002"), dict(id="c", source="lo", dob="02/01/1970", nationality="unknown", listed_on="03/01/2002"), dict(id="d", source="none", dob="-"),
    ])
    g = spark.createDataFrame([(x, "a") for x in "abcd"], "id string, group_id string")
    s = spark.createDataFrame([("hi", 4), ("lo", 1)], "source string, trust int")
    got = {r["field"]: r["id"] for r in survivors.winners(survivors.graded(g, e, s)).collect()}
    assert got == {"dob": "c", "nationality": "a", "designation": "a"}
    rec = survivors.golden_records(survivors.graded(g, e, s)).collect()
    assert len(rec) == 1 and rec[0]["dob_id"] == "c" and rec[0]["identifiers"] is None


# --- matching ------------------------------------------------------------------------------------


def test_best_of_a_block_without_scoring_all_pairs(monkeypatch):
    import numpy as np
    import pandas as pd

    rng, read = np.random.default_rng(4), []
    ranges = entity_match._ranges
    monkeypatch.setattr(entity_match, "_ranges", lambda a, b: read.append(int((b - a).sum())) or ranges(a, b))
    for k, few, first, room in ((2, 1, 1, 40), (1, 4, 3, 1000), (3, 1000, 2, 7), (2, 2, 10**6, 10**6)):
        rows = [sorted({int(x) for x in rng.zipf(1.3, rng.integers(0, 12)) if x < 60}) for _ in range(90)]
        rows = [[*r, *[100 + x for x in r if x < 3]] for r in rows]  # terms that go together
        df = np.bincount(np.concatenate(rows).astype(int), minlength=200)
        p = pd.DataFrame({"side": [i % 2 for i in range(90)], "id": [f"e{i:02}" for i in range(90)], "source": "s", "norm": [2.2 / (1 + 1.2 * (0.6 + 0.4 * len(r) / 7)) for r in rows], "terms": [np.array(r, np.int64) for r in rows], "dfs": [df[np.array(r, int)].astype(np.int32) for r in rows]})
        a, b = (entity_match._Side(p[p["side"] == s]) for s in (0, 1))
        w = np.log1p((90 - df + 0.5) / (df + 0.5))
        at = [np.where(np.isin(x.term, y.term), x.term, -1) for x, y in ((a, b), (b, a))]
        got = sorted((a.ids[i], b.ids[j], round(s, 6)) for i, j, s in zip(*entity_match._best_of(a, b, *at, w, k, few, first, room)))
        want = []
        for i in range(0, 90, 2):
            s = sorted((-round(sum(w[t] for t in set(rows[i]) & set(rows[j])) * (p["norm"][i] + p["norm"][j]) / 2, 9), j) for j in range(1, 90, 2))
            want += [(f"e{i:02}", f"e{j:02}", round(-x, 6)) for x, j in s[:k] if x < 0]
        assert got == sorted(want)
    # a term that all share is not read by all
    rows = [[i % 20, 20 + i // 40, 100] for i in range(800)]
    df = np.bincount(np.concatenate(rows))
    p = pd.DataFrame({"side": [i // 20 % 2 for i in range(800)], "id": [f"e{i:03}" for i in range(800)], "source": "s", "norm": 1.0, "terms": [np.array(r) for r in rows], "dfs": [df[r] for r in rows]})
    read.clear()
    assert len(entity_match._block_best(p, 2, 800.0)) and max(read) < 400 * 400 / 2


def test_retrieval_is_exact(spark):
    """The two best partners in every other source equal those of a full comparison of all entries."""
    e = spark.read.parquet(DIR + "/sanctions_entities.parquet")
    entries = entity_match.indexed(entity_match.entity_profiles(e)).cache()
    got = collections.defaultdict(list)
    for r in entity_match.retrieve(entries).collect():
        got[r["a"], r["source_b"]].append((round(r["score"], 6), r["b"]))
        got[r["b"], r["source_a"]].append((round(r["score"], 6), r["a"]))
    rows = [(r["id"], r["source"], set(r["terms"])) for r in entries.select("id", "source", "terms").collect()]
    n, mean = len(rows), sum(len(t) for _, _, t in rows) / len(rows)
    df = collections.Counter(t for _, _, ts in rows for t in ts)
    import math

    idf = {t: math.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items() if c > 1}
    norm = {i: 2.2 / (1 + 1.2 * (0.6 + 0.4 * len(t) / mean)) for i, _, t in rows}
    best = collections.defaultdict(list)
    for x, (i, s, t) in enumerate(rows):
        for j, u, v in rows[x + 1 :]:
            if s != u:
                w = sum(idf[k] for k in t & v if k in idf) * (norm[i] + norm[j]) / 2
                if w > 0:
                    best[i, u].append((round(w, 6), j))
                    best[j, s].append((round(w, 6), i))
    for k, v in best.items():
        want = sorted((w for w, _ in v), reverse=True)[:2]
        have = sorted((w for w, _ in got[k]), reverse=True)[:2]
        assert all(abs(p - q) < 1e-4 for p, q in zip(want, have)) and len(want) <= len(have), k


def test_matches_against_labels(spark):
    e, lab = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("sanctions_entities", "pair_labels"))
    m = {(r["a"], r["b"]) for r in entity_match.same_person(entity_match.match_entities(e, lab)).collect()}
    hit = collections.Counter((r["same_person"], (min(r["id_a"], r["id_b"]), max(r["id_a"], r["id_b"])) in m) for r in lab.collect())
    assert hit[True, True] >= 0.9 * (hit[True, True] + hit[True, False]) and hit[False, True] <= 0.1 * hit[True, True]


def test_matching_edges(spark):
    rows = [dict(id="a", name="Maksim Gomsolopak", dob="1970-01-02"), dict(id="b", source="eu", name="GOMSOLOPAK, Maxim", dob="2 Jan 1970"), dict(id="c", source="eu"), dict(id="d", source="uk", name="х" * 5000), dict(id="b", source="eu", name="GOMSOLOPAK, Maxim", dob="2 Jan 1970"), dict(id="e", source="uk", name="Maksim Gomsolopak", dob="1990-05-06")]
    got = entity_match.same_person(entity_match.match_entities(ent(spark, rows).withColumn("terms", F.lit("clash")).withColumn("score", F.lit(0)))).collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", "b")]
    assert entity_match.match_entities(ent(spark, []), None).count() == 0


def test_banding_recall():
    for s in (0.4, 0.55, 0.7):
        r, b = name_variants.tune_bands(s, 0.95)
        assert 1 - (1 - s**r) ** b >= 0.95
    forms = ["maksim gomsolopak", "max gomsolopakk", "gomsolopak maxim", ""]
    i, k = name_variants.bands_of(forms, 4, 32)
    keys = collections.defaultdict(set)
    for x, y in zip(i, k):
        keys[x].add(y)
    assert keys[0] == keys[2] and keys[0] & keys[1] and 3 not in keys


def test_screening_links(spark):
    e = ent(spark, [dict(id="a", name="Maksim Gomsolopak", dob="1970-01-02", nationality="IR"), dict(id="b", name="GOMSOLOPAK, Maxim", aliases="Max Gomsolopakk", nationality="Iran"), dict(id="c", name="Ivan Gomsolopak"), dict(id="d")])
    js = ['{"name": "dr maxim  gomsolopak", "dob": "02/01/1970", "nationality": "Iranian"}', '{"name": "Maksim Gomsolopak", "dob": "1991-01-02"}', '{"name": ""}', "broken", None, '{"name": null}', "[1]"]
    s = spark.createDataFrame([(f"s{i}", j) for i, j in enumerate(js)] + [("s0", js[0])], "id string, user_input string")
    got = sorted((r["screening_id"], r["entity_id"]) for r in name_variants.link_screenings(s, e).collect())
    assert got == [("s0", "a"), ("s0", "b")]
    assert name_variants.link_screenings(s.limit(0), e).count() == 0


# --- text ----------------------------------------------------------------------------------------


def test_consistent_form(spark):
    rows = ["Rоman", "Roman", "Ｒｏｍａｎ", "Ro​man Z", "José", "José", "Роман Волков", "Ivan (Иван Волков)", "А. Smith", "ﬁne", "a b", "Пaвeл Волков", "", None, "Gɑmdad", "x‑y", "ر" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r["t_consistent"] for r in lookalikes.consistent_form(df, ["t"]).orderBy("i").collect()]
    assert got == ["Roman", "Roman", "Roman", "Roman Z", "José", "José", "Роман Волков", "Ivan (Иван Волков)", "A. Smith", "fine", "a b", "Павел Волков", "", None, "Gamdad", "x-y", "ر" * 3]
    again = spark.createDataFrame([(t,) for t in got], "t string")
    assert all(r["t"] == r["t_consistent"] for r in lookalikes.consistent_form(again, ["t"]).collect())
    assert lookalikes.consistent_form(df.limit(0), ["t"]).count() == 0


def test_tokens_equal_reference_library(spark):
    import tiktoken

    e = tokenizer.encoder(tokenizer.vocabulary())
    ref = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    texts = ["", " ", "Hello  world\n\n", "naïve 東京 🙂", "a" * 3000, "<|endoftext|>", "x\r\n\ty", "1234567890 " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id int, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokenizer.token_ids(df).collect()}
    assert got.pop(99) == [] and got == {i: ref.encode_ordinary(t) for i, t in enumerate(texts)}
    docs = spark.read.parquet(DIR + "/documents.parquet").select("doc_id", "text")
    for r in tokenizer.token_ids(docs).collect():
        assert list(r["ids"]) == (ref.encode_ordinary(r["text"]) if r["text"] else [])


@given(st.binary(min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_merges_brute_force(word):
    ranks = tokenizer.encoder(tokenizer.vocabulary()).ranks
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert tokenizer.encode_word(word, ranks) == [ranks[p] for p in parts]


def test_packing(spark):
    docs = spark.read.parquet(DIR + "/documents.parquet").select("doc_id", "text", F.lit("c").alias("tokens"))
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(10**9, "word " * 5000, "c")], docs.schema))
    out = packing.pack(docs, [("w", 512), ("v", 100)], shard_rows=400).toPandas()
    e = tokenizer.encoder(tokenizer.vocabulary())
    size = collections.Counter()
    for r in docs.collect():
        size[r["doc_id"]] += e.count(r["text"])
    for w, cap in (("w", 512), ("v", 100)):
        o = out[out.window_name == w]
        assert o.groupby("doc_id").tokens.sum().to_dict() == dict(size) and o.groupby("container_id").tokens.sum().max() <= cap
        for d, g in o.groupby("doc_id"):
            if size[d] <= cap:
                assert set(g.piece_no) == {0}
        assert o.tokens.sum() / (o.container_id.nunique() * cap) > 0.93
    assert packing.pack(docs.limit(0), [("w", 10)]).count() == 0


def test_truncation(spark):
    rng = random.Random(1)
    subjects, verbs, objects = ["The clerk", "A pilot", "The consulate"], ["approved", "withheld", "forwarded"], ["the invoice near Hamento", "a loan of 40 m", "the minutes of the board"]
    full = [" ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(objects)}." for _ in range(rng.randrange(2, 8))) for _ in range(1500)]
    cut = {i: full[i][: len(full[i]) - rng.randrange(3, 12)] for i in range(0, 1500, 20)}
    rows = [(i, cut.get(i, t), "en", "src", "a") for i, t in enumerate(full)]
    rows += [(9001, None, "en", "src", "a"), (9002, "", None, None, None), (9003, " \n", "en", "src", "a"), (9004, '{"a": [1, 2', "en", "src", "json")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc_type string")
    got = {r["doc_id"] for r in truncation.detect_truncated(df).filter("cut").collect()}
    assert 9004 in got and not got & {9001, 9002, 9003}
    assert len(got & set(cut)) >= 0.9 * len(cut) and len(got - set(cut) - {9004}) <= 0.01 * len(full)
    assert truncation.detect_truncated(df.limit(0)).count() == 0


def test_columns_of_found_queries(spark):
    d = "/root/testdata/sf0.001"
    want = {"p1_found": ["id_a", "id_b"], "p2_found": ["group_id", "field", "id"], "p3_found": ["id", "group_id"], "p4_found": ["screening_id", "entity_id"], "p5_found": ["id", "field"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}
    qs = queries.queries()
    for k, cols in want.items():
        assert qs[k](spark, d).columns == cols


def test_retrieval_within_a_hot_group(spark):
    from watchloom.llm import entity_match

    rows = [(f"x{i:03}", "x", ["k:khan", f"r:{i}"]) for i in range(160)] + [(f"y{i:03}", "y", ["k:khan", f"q:{i}"]) for i in range(160)] + [("y999", "y", ["k:khan", "n:omar|khan"])]
    entries = spark.createDataFrame(rows, "id string, source string, terms array<string>")
    for block in (12_000, 50):
        got = entity_match.retrieve(entries, block=block).collect()
        best = {}
        for r in got:
            best.setdefault(r["a"], set()).add(r["b"])
        assert len(best) == 160 and all({"y000", "y001"} <= v for v in best.values())
    near = entity_match.mutual_nearest(entity_match.retrieve(entries)).collect()
    assert [(r["a"], r["b"]) for r in near] == [("x000", "y000")]


def test_slips_in_given_names_meet(spark):
    from watchloom.llm import name_variants

    pairs = [("nomar gomsolopak", "tomar gomsolopak"), ("zelim kimdiriruddin", "delim kimdiriruddin"), ("tarvok hartanutouri", "tarlok hartanutoury")]
    typed, listed = (spark.createDataFrame([(p[i],) for p in pairs], "form string") for i in (0, 1))
    got = {tuple(r) for r in name_variants.candidate_pairs(typed, listed, 3, 32).collect()}
    assert got == set(pairs)
    dated = [name_variants.evidence_keys(spark.createDataFrame([(f, [[4, 1970, 1970, 1, 2]], [])], "form string, dobs array<array<int>>, nums array<string>")) for f in ("qadvik gomsolopak", "tarlo gomsolopk")]
    from watchloom.llm import attributes

    assert attributes.FULL == 4 and name_variants.dated_pairs(*dated).count() == 1


def test_split_and_glued_names_meet(spark):
    pairs = [("anatolii voms ensky", "anatoliy vomsensky"), ("jean pierretikranunngo", "jean pierre tikranunngo"), ("m f boubautkele", "musa francois boubautkele"), ("asif gokl ashana", "aasif habibullah goklashana"), ("michaildilvadunov anatoly", "mikhail dilvadunov anatoly")]
    typed, listed = (spark.createDataFrame([(p[i],) for p in pairs], "form string") for i in (0, 1))
    got = {(r["typed"], r["listed"]) for r in name_variants.link_variants(typed, listed).collect()}
    assert got == set(pairs)


def test_hot_key_is_salted(spark):
    a = spark.createDataFrame([(1, i) for i in range(1000)] + [(2, 1), (None, 5)], "k int, a int")
    b = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (None, 6)], "k int, b int")
    assert sorted(map(tuple, name_variants.salted_join(a, b, ["k"], 10).collect())) == sorted(map(tuple, a.join(b, "k").collect()))


def test_undated_subjects(spark):
    """A name with nothing to compare is a link, unless another entry of the name shows the subject to be a namesake."""
    e = ent(spark, [dict(id="a", name="Maksim Gomsolopak"), dict(id="b", name="Ivan Rilradazov", dob="1950-01-02", nationality="RU"), dict(id="c", name="Ivan Rilradazov")])
    js = ['{"name": "Maxim Gomsolopak"}', '{"name": "Ivan Rilradazov", "dob": "1990-05-06", "nationality": "FR"}', '{"name": "Ivan Rilradazov", "nationality": "FR"}', '{"name": "Ivan Rilradazov", "nationality": "Russia"}']
    s = spark.createDataFrame([(f"s{i}", j) for i, j in enumerate(js)], "id string, user_input string")
    got = sorted((r["screening_id"], r["entity_id"]) for r in name_variants.link_screenings(s, e).collect())
    assert got == [("s0", "a"), ("s3", "b"), ("s3", "c")]


def test_few_rows_of_parts_and_keys_are_shuffled(spark):
    """Signs hold back no parts that are close, but most others; keys that aren't hot make neither side of a join be shuffled twice."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(4)
    base = ["gomsolopak", "al gomsolopaki", "rilradazov", "ben dovar", "kimdiriruddin", "x", "дмитров", "aa bb", "zed" * 15]

    def part():
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice("aeiou ")
        return " ".join("".join(t).split()) or "y"

    one, two = ({part() for _ in range(60)} for _ in range(2))
    a, b = (name_variants.described(spark.createDataFrame([(x,) for x in sorted(p)], "part string")) for p in (one, two))
    side = lambda x, s: x.select(*[F.col(c).alias(c + s) for c in x.columns])
    got = {(r["part_t"], r["part_l"]): r for r in side(a, "_t").crossJoin(side(b, "_l")).withColumn("may", name_variants._can_meet()).collect()}

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    close = 0
    for r in got.values():
        w, z = r["whole_t"], r["whole_l"]
        n, m = min(len(w), 31), min(len(z), 31)
        k, u, v = max(1, int(0.13 * max(n, m))), {ord(c) % 26 for c in w}, {ord(c) % 26 for c in z}
        first = len(u ^ v) <= 2 * k if abs(n - m) <= k else u <= v or v <= u
        near = any(edits(x, y) <= max(1, int(0.13 * max(len(x), len(y)))) or sorted(x) == sorted(y) for x, y in ((r[c + "_t"], r[c + "_l"]) for c in name_variants.TEXTS))
        if first and (near or min(len(w), len(z)) >= 6 and (w in z or z in w)):
            close += 1
            assert r["may"], (w, z)
    assert close > 50 and sum(r["may"] for r in got.values()) < 3 * close
    x, y = (name_variants.materialize(spark.range(500).select((F.col("id") % 250).alias("k"), F.col("id").alias(c))) for c in "xy")
    plan = name_variants.salted_join(x, y, ["k"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
