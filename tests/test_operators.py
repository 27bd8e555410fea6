import io
import itertools
import json
import random
import zipfile
from datetime import datetime

from watchloom.operators import report, resolve, retrieval, store
from watchloom.operators.components import connected_components
from watchloom.operators.snapshot_diff import diff_snapshots
from watchloom.streaming.screen import screen_stream

SNAP = "refresh_no int, source string, id string, name string, aliases string, dob string, nationality string, identifiers string, designation string, listed_on string, programs string, loaded_at timestamp"
META = "refresh_no int, source string, last_fetched timestamp, entity_count int, file_hash string, status string"
T = datetime(2026, 1, 1)


def snap(n, i, **k):
    base = dict(name="A B", aliases="x|y", dob="", nationality=None, identifiers="[]", designation=None, listed_on=None, programs="p")
    base.update(k)
    return (n, "s", i, *[base[c] for c in ("name", "aliases", "dob", "nationality", "identifiers", "designation", "listed_on", "programs")], k.get("loaded_at", T))


def test_snapshot_diff_edges(spark):
    ids = '[{"type":"p","value":"1","country":"X"},{"type":"q","value":"2","country":""}]'
    same = '[ {"country":"", "value":"2", "type":"q"}, {"value":"1","type":"p","country":"X"} ]'
    rows = [
        snap(1, "a"), snap(1, "a"), snap(1, "b", identifiers=ids), snap(1, "gone"), snap(1, None), snap(1, "chg"), snap(1, "sp"),
        snap(2, "junk"),
        snap(3, "a", aliases=" y |x", identifiers=None, dob=None), snap(3, "b", identifiers=same), snap(3, "new"), snap(3, "chg", dob="1970"), snap(3, "sp", name="  A   B "),
    ]
    meta = [(1, "s", T, 1, "h1", "ok"), (2, "s", T, 0, None, "error"), (3, "s", datetime(2026, 1, 2), 0, "", "error"), (3, "s", datetime(2026, 1, 3), 5, "h3", "ok"), (3, "s", datetime(2026, 1, 3), 5, "h3", "ok")]
    extra = spark.createDataFrame(rows, SNAP)
    from pyspark.sql import functions as F

    got = diff_snapshots(extra.withColumn("h", F.lit("clash")).withColumn("change", F.lit(1)), spark.createDataFrame(meta, META))
    assert sorted((r["id"], r["refresh_no"], r["change"]) for r in got.collect()) == [("chg", 3, "changed"), ("gone", 3, "removed"), ("new", 3, "added")]
    assert diff_snapshots(spark.createDataFrame([], SNAP), spark.createDataFrame([], META)).count() == 0


def test_components_any_shape(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(20)] + [("q", "q"), (None, "z")]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "a string, b string")).collect()}
    assert {got[f"{i:03}"] for i in range(61)} == {"000"} and got["leaf7"] == "hub" and "q" not in got
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_last_wins_and_signature(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "id string, n int, v string")
    assert sorted((r["id"], r["v"]) for r in store.last_wins(df, ["id"], ["n"]).collect()) == [("a", "y"), ("b", "z")]


def test_snapshot_store(spark, tmp_path):
    s = store.SnapshotStore(spark, "file://" + str(tmp_path / "w"))
    df = spark.createDataFrame([("a", "x")], "id string, source string")
    assert s.publish(df) and s.current().count() == 1
    assert s.publish(df.filter("id = 'none'")) is None and s.current().count() == 1
    assert s.publish(df.union(df)) and s.current().count() == 2


def test_union_by_priority(spark):
    a = spark.createDataFrame([("s", "1", 9)], "subject string, id string, ord int")
    b = spark.createDataFrame([("s", "1", 1), ("s", "2", 2)], "subject string, id string, ord int")
    got = retrieval.union_by_priority([a, b], ["subject", "id"], 2, "subject").collect()
    assert sorted((r["id"], r["ord"]) for r in got) == [("1", 9), ("2", 2)]


def test_bm25_against_brute_force(spark):
    import math

    ents = [("e1", "ali khan"), ("e2", "alia khan khan"), ("e3", "omar"), ("e4", None)]
    idx = retrieval.token_index(spark.createDataFrame(ents, "id string, name string"), ("name",))
    q = spark.createDataFrame([("s", "ali"), ("s", "khan"), ("t", "zzz")], "subject string, q string")
    got = {(r["subject"], r["id"]): r["rank_score"] for r in retrieval.bm25_topk(q, idx, 10).collect()}
    docs = {"e1": ["ali", "khan"], "e2": ["alia", "khan"], "e3": ["omar"]}
    mean = sum(map(len, docs.values())) / 3
    want = {}
    for w in ("ali", "khan"):
        tf = {i: sum(t.startswith(w) for t in d) for i, d in docs.items()}
        df = sum(v > 0 for v in tf.values())
        for i, v in tf.items():
            if v:
                want[("s", i)] = want.get(("s", i), 0) + math.log1p((3 - df + 0.5) / (df + 0.5)) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_workbook():
    data = report.workbook({"Matches": [["#", "Decision"], [1, "CLEARED"], [2, "x" * 40000]]})
    z = zipfile.ZipFile(io.BytesIO(data))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "autoFilter" in sheet and "frozen" in sheet and 's="2"' in sheet and "x" * 32001 not in sheet


def test_stream(spark, tmp_path):
    ents = spark.createDataFrame([("e1", "Omar Farouk", "Omar Farouk", "Omar Farouk", "", "OMR FRK", "O560 F620")], "id string, name string, name_latin string, name_ascii string, aliases string, phonetic_primary string, phonetic_alt string")
    src = str(tmp_path / "in")
    spark.createDataFrame([("s1", "omar farouk", T), ("s1", "omar farouk", T)], "subject string, name string, created_at timestamp").write.parquet(src)
    stream = spark.readStream.schema("subject string, name string, created_at timestamp").parquet(src)
    q = screen_stream(stream, ents, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["subject"], r["id"], r["score"]) for r in got] == [("s1", "e1", 100.0)]


ENTITY = "id string, source string, name string, aliases string, dob string, nationality string, identifiers string"


def persons_by(spark, rows, pairs=None):
    from pyspark.sql import functions as F

    e = spark.createDataFrame(rows, ENTITY)
    for c in resolve.RICHNESS:
        e = e if c in e.columns else e.withColumn(c, F.lit(""))
    got = resolve.persons(e, resolve.judged_pairs(resolve.blocked_pairs(e) if pairs is None else spark.createDataFrame(pairs, "id_a string, id_b string"), e))
    return sorted(((r["person"], r["representative"], r["members"], ",".join(sorted({x["source"] or "" for x in r["all_sources"]})), tuple(r["all_names"]), tuple(map(tuple, r["all_identifiers"])), r["uncertain_merge"]) for r in got.collect()))


def test_persons_as_by_all_pairs(spark):
    rnd = random.Random(5)
    base = ["navid javed khan kimdiriruddin", "maria del carmen fernandez gutierrez", "al", "", "olga petrovna ivanova-smirnova of the north west"]
    rows = []
    for i in range(150):
        name = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
            at = rnd.randrange(len(name) + 1)
            name[at : at + rnd.randrange(2)] = rnd.choice("aeiou ")
        ids = [{"type": "p", "value": str(rnd.randrange(60))}] if rnd.random() < 0.4 else []
        dob = rnd.choice(("", "", f"19{rnd.randrange(40, 99)}", "1970|1971", "1971|1972", "1970|1972"))
        rows.append((f"{i:03}", rnd.choice(("x", "y", "", None)), "".join(name), "", dob, rnd.choice(("", "", "PK", "ES|PK", "RU", "NL")), json.dumps(ids)))
    assert persons_by(spark, rows) == persons_by(spark, rows, list(itertools.combinations([r[0] for r in rows], 2)))


def test_near_equal_names_are_judged(spark):
    got = persons_by(spark, [("1", "x", "Navid Javed Khan Kimdiriruddin", "", "", "PAKISTAN", "[]"), ("2", "x", "Naveed Javed Khan Kimdiriruddin", "", "", "PAKISTAN", "[]")])
    assert [(r[0], r[2], r[6]) for r in got] == [("1", 2, True)]


def test_uncertain_pair_behind_sure_links(spark):
    rows = [(str(i), "x", "Omar Farouk", "", dob, "EG", "[]") for i, dob in enumerate(("1970|1971", "1970", "1971"))]
    assert persons_by(spark, rows)[0][6] is True


def test_block_of_any_size_is_whole(spark):
    rows = [(f"{i:03}", "x", f"q{i}", "", "", "", '[{"type": "p", "value": "1"}]') for i in range(502)]
    assert [(r[0], r[2], r[6]) for r in persons_by(spark, rows)] == [("000", 502, False)]


def test_screen_topk_keeps_all_of_a_hot_name(spark, tmp_path):
    from watchloom.plans import queries

    cols = "id string, name string, name_latin string, name_ascii string, aliases string, phonetic_primary string, phonetic_alt string"
    spark.createDataFrame([(f"e{i:02}", "Omar Farouk", "Omar Farouk", "Omar Farouk", "", "OMR FRK", "O560 F620") for i in range(41)], cols).write.parquet(str(tmp_path / "sanctions_entities.parquet"))
    spark.createDataFrame([("s1", '{"name": "omar farouk"}')], "id string, user_input string").write.parquet(str(tmp_path / "screenings.parquet"))
    for q in ("screen_topk", "bm25_candidates", "phonetic_candidates"):
        assert queries.queries()[q](spark, str(tmp_path)).count() == 41


def test_persons_unite_names_and_documents(spark):
    rows = [("a", "x", "Omar Farouk", "OMAR FAROUK|Umar", "", "", '[{"type": "P", "value": "1", "country": "EG"}]'), ("b", "y", "omar farouk", "Omar F.", "1970", "", '[{"type": "p", "value": "1", "country": ""}, {"type": "", "value": "9"}]')]
    got = persons_by(spark, rows)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [("a", "b", 2, "x,y", ("Omar Farouk", "Umar", "Omar F."))]
    assert got[0][5] == (("P", "1", "EG"),)


def test_routes_are_numbered_and_overridden(spark):
    cols = "screening_id string, person string, ord int, decision string, reason string, cleared_by string"
    flagged, cleared, reviewed = (spark.createDataFrame(x, cols) for x in ([("s", "f", 5, "LIKELY_MATCH", "id", "")], [("s", "c", 1, "CLEARED", "dob", "rule")], [("s", "r", 1, "ESCALATE", "?", ""), ("s", "q", 2, "ESCALATE", "?", ""), ("t", "z", 1, "CLEARED", "", "ai")]))
    second = spark.createDataFrame([("s", "q", "CLEARED", "found", "second")], "screening_id string, person string, decision string, reason string, cleared_by string")
    urls = spark.createDataFrame([("s", "q", i, u) for i, u in enumerate(["a", " ", None, "b", "c", "d"])], "screening_id string, person string, ord int, url string")
    got = report.numbered_routes(flagged, cleared, reviewed, second, urls).collect()
    assert sorted((r["screening_id"], r["match_number"], r["person"], r["decision"], r["citations"]) for r in got) == [
        ("s", 1, "f", "LIKELY_MATCH", ""), ("s", 2, "c", "CLEARED", ""), ("s", 3, "r", "ESCALATE", ""), ("s", 4, "q", "CLEARED", "a; b; c"), ("t", 1, "z", "CLEARED", "")]


def test_screening_is_the_same_in_blocks(spark):
    from watchloom.plans import queries, screening
    from watchloom.session import table

    d = "/root/testdata/sf0.001"
    s, e = screening.subjects_of(table(spark, d, "screenings")).limit(60), queries._entities(spark, d)
    whole = sorted(screening.screen(s, e, candidates=7, threshold=40.0).collect())
    assert whole and whole == sorted(screening.screen(s, e, candidates=7, threshold=40.0, block=30, part=20).collect())


def test_block_scores_equal_plain_ones():
    import numpy as np

    from watchloom.functions import similarity as S

    rnd, words = random.Random(1), ["muhammad", "ali", "khan", "x", "kimdiriruddin", "maria del", "fernandez gutierrez", "ali ali", "", "zed" * 30]

    def name():
        t = list(" ".join(rnd.choice(words) for _ in range(rnd.randrange(4))))
        for _ in range(rnd.randrange(3)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice("aeiou ")
        return " ".join("".join(t).split())

    names = sorted({name() for _ in range(400)})
    block, rows = S.NameBlock(names), np.arange(len(names))
    for q in (name() for _ in range(30)):
        want = [100.0 if q and q == n else S.blend(q, n) if q and n else 0.0 for n in names]
        for least in (0.0, 60.0):
            assert np.allclose(block.scores(q, rows, least), [w if w >= least else 0.0 for w in want])
    pairs = [(name(), name()) for _ in range(500)]
    assert [S._lcs(a, b) for a, b in pairs] == S.lcs_many([a for a, _ in pairs], [b for _, b in pairs]).tolist()


def plain_bm25(queries, docs, k):
    """subject, id, score, place by the plain formula; ``queries``: tokens of a subject, ``docs``: tokens of an entity."""
    import math

    mean, out = sum(map(len, docs.values())) / len(docs), []
    for s, qs in queries.items():
        score = {}
        for w in qs:
            tf = {i: n for i, d in docs.items() if (n := sum(t.startswith(w) for t in d))}
            for i, v in tf.items():
                score[i] = score.get(i, 0) + math.log1p((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
        best = sorted((-round(x, 6), i) for i, x in score.items())[:k]
        out += [(s, i, round(-x, 5), n) for n, (x, i) in enumerate(best, 1)]
    return sorted(out)


def many_names(spark, seed):
    rnd, words = random.Random(seed), ["ali", "alia", "khan", "khanum", "omar", "zed"]
    docs = {f"e{i:02}": sorted({rnd.choice(words) for _ in range(3)}) for i in range(40)}
    queries = {f"s{i}": sorted({rnd.choice(["ali", "kha", "omar", "ze", "none"]) for _ in range(2)}) for i in range(9)}
    index = retrieval.token_index(spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "id string, name string"), ("name",))
    return queries, docs, spark.createDataFrame([(s, q) for s, qs in queries.items() for q in qs], "subject string, q string"), index


def test_bm25_results_leave_blocks_without_a_shuffle(spark):
    queries, docs, asked, index = many_names(spark, 3)
    got = retrieval.bm25_topk(asked, index, 7, block=6, part=2)
    assert sorted((r["subject"], r["id"], round(r["rank_score"], 5), r["ord"]) for r in got.collect()) == plain_bm25(queries, docs, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan.split("MapInArrow")[0].replace("AdaptiveSparkPlan", "")


def test_a_long_name_does_not_widen_the_block():
    import numpy as np

    from watchloom.functions import similarity as S

    names = ["omar farouk", "farouk omar", "omar x", "omar " * 3 + "farouk " * 150 + "end", "\U00010400mar"]
    block, q = S.NameBlock(names), "omar farouk"
    assert sum(c.nbytes for c in block.codes) <= 2 * 64 * len(names)
    assert np.allclose(block.scores(q, np.arange(5)), [100.0] + [S.blend(q, n) for n in names[1:]])


def test_hundredths_round_as_sql(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from watchloom.plans.screening import hundredths

    x = [60.005, 61.115, 72.675, 99.995, 60.0, 77.77499999999999, 83.125, 64.32500000000002]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 2).alias("y")).collect()
    assert [r["y"] for r in got] == hundredths(np.array(x)).tolist()


def test_bm25_entities_are_not_repeated_for_parts(spark):
    queries, docs, asked, index = many_names(spark, 4)
    got = retrieval.bm25_topk(asked, index, 5, block=10, part=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Union" not in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted((r["subject"], r["id"], round(r["rank_score"], 5), r["ord"]) for r in got.collect()) == plain_bm25(queries, docs, 5)


def test_document_frequencies_need_no_rows_of_pairs(spark):
    import math

    from pyspark.sql import functions as F

    queries, docs, asked, index = many_names(spark, 5)
    n, mean = retrieval.size_of(index)
    blocks = retrieval.indexed_blocks(retrieval.documents(index).select("id", F.array().cast("array<string>").alias("names"), "tokens", "tfs"), 9)
    got = retrieval.weighted_queries(asked, blocks, [(mean, 1.2, 0.75)], n)
    df = {q: sum(any(t.startswith(q) for t in d) for d in docs.values()) for q in ("ali", "kha", "omar", "ze", "none")}
    want = {s: [(q, round(math.log1p((n - df[q] + 0.5) / (df[q] + 0.5)), 9)) for q in qs if df[q]] for s, qs in queries.items()}
    assert len(blocks) > 1 and {r["subject"]: [(q, round(x, 9)) for q, x in zip(r["qs"], r["idfs"])] for r in got.collect()} == {s: v for s, v in want.items() if v}
    assert "count(distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_rows_of_like_subjects_are_neighbours(spark):
    from pyspark.sql import functions as F

    queries, docs, _, index = many_names(spark, 6)
    queries = {f"{i:02}{s}": qs for i in range(12) for s, qs in queries.items()}
    asked = spark.createDataFrame([(s, q) for s, qs in queries.items() for q in qs], "subject string, q string")
    got = retrieval.bm25_topk(asked, index, 7, block=11, part=25).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert sorted((r["subject"], r["id"], round(r["rank_score"], 5), r["ord"]) for r in got) == plain_bm25(queries, docs, 7)
    lists = {s: tuple((x[1], x[2]) for x in plain_bm25({s: qs}, docs, 7)) for s, qs in queries.items()}
    seen = [lists[r["subject"]] for r in got]
    assert len([x for x, _ in itertools.groupby(seen)]) == len(set(seen))


def test_runs_of_equal_lists():
    import pyarrow as pa

    first, of = retrieval.runs_of(pa.chunked_array([[["a", "b"], ["a", "b"], ["a", "c"]], [["a", "c"], ["ac"], [], []]]))
    assert first.tolist() == [0, 2, 4, 5] and of.tolist() == [0, 0, 1, 1, 2, 3, 3]


def test_lists_of_like_subjects_are_one_row(spark, tmp_path):
    from watchloom.plans import queries as q

    queries, docs, _, index = many_names(spark, 8)
    queries = {f"{i:02}{s}": qs for i in range(5) for s, qs in queries.items()}
    asked = spark.createDataFrame([(s, w) for s, qs in queries.items() for w in qs], "subject string, q string")
    lists = retrieval.bm25_lists(asked, index, 7, block=11, part=25)
    assert sorted(map(tuple, retrieval.in_rows(lists).collect())) == [(s, i, n) for s, i, _, n in plain_bm25(queries, docs, 7)]
    got = [[tuple(w for w in queries[s] if w != "none") for s in r["subjects"]] for r in lists.collect()]
    assert all(len(set(x)) == 1 for x in got) and len(got) < len(queries)
    cols = "id string, phonetic_primary string, phonetic_alt string"
    spark.createDataFrame([(f"e{i:02}", "OMR FRK", "O560 F620") for i in range(41)], cols).write.parquet(str(tmp_path / "sanctions_entities.parquet"))
    spark.createDataFrame([(f"s{i}", '{"name": "omar farouk"}') for i in range(3)], "id string, user_input string").write.parquet(str(tmp_path / "screenings.parquet"))
    found = q.queries()["phonetic_candidates"](spark, str(tmp_path))
    assert sorted((r["id"], r["ord"]) for r in found.collect()) == [(f"e{i:02}", i + 1) for i in range(41)]
    assert "posexplode" in found._jdf.queryExecution().optimizedPlan().toString()  # rows aren't made in Python
