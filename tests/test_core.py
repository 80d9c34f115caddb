import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import strsim
from tessera.functions import text as X
from tessera.operators import artifacts, blocking, decide, features, metrics, model, normalize
from tessera.sources import io

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "ns")]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text_golden(spark):
    lit = F.lit
    assert one(spark, X.base_clean(lit("l.l.c."))).strip() == "llc"
    assert one(spark, X.base_clean(lit("None"))) == ""
    assert one(spark, X.base_clean(lit(None).cast("string"))) == ""
    assert one(spark, X.fold(lit("Élan Çà"))) == "elan ca"
    assert [one(spark, X.leet(lit(t))) for t in ("5mart", "si1ver", "gr0up", "7nd")] == ["smart", "silver", "group", "7nd"]
    assert one(spark, X.skeleton(lit("private"))) == one(spark, X.skeleton(lit("praaivet"))) == "prvt"
    assert X.translit("राम") == "raam"  # long vowels stay double, the last inherent vowel goes
    main, former = X.alias_split(lit("Old Co f/k/a New Co"))
    assert (one(spark, main), one(spark, former)) == ("New Co", "Old Co")
    assert one(spark, X.digits(lit("7th road second floor"))) == "7 road 2 floor"
    assert one(spark, X.street_canonical(F.array(lit("st"), lit("de")), lit("France"))) == ["saint"]
    assert one(spark, X.units(lit("apt-04b no 15 rte 66"))) == ["apt4b"]
    logp = {"mona": -2.0, "manufacturing": -3.0}
    assert X.segment("monamanufacturing", logp) == ["mona", "manufacturing"]


def test_plain_records(spark):
    import math

    logp = {"US": {w: math.log(0.01) for w in ("mona", "manufacturing", "tools")}}
    rows = [
        ("S2-1", "राम स्टोर", "12 मार्ग", "India"), ("S2-2", "www.monamanufacturing.com # 7", "1 Oak", "US"), ("S2-3", "ﬁne ½ Œuvre", "ℌill 5", "US"),
        ("S2-4", "Acme # 12 (id 77) Tools", None, "US"), ("S2-5", None, "x", "US"), ("S2-6", "@monatools", "x", "France"), ("S2-7", "Old LLC fka New Co", "x", "US"), ("S2-8", "भारत tools", "x", "India"),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "entity_id string, business_name string, business_address string, country string, odd int")
    got = {r.entity_id: r for r in normalize.normalise(d, lexicon={"भारत": "bharat"}, logp=logp).collect()}
    assert len(got) == len(rows)
    assert got["S2-1"].nw == ["raam", "stor"] and got["S2-1"].ad == ["12"] and got["S2-1"].aw == ["maarg"]
    assert got["S2-2"].nw == ["mona", "manufacturing"] and got["S2-6"].nw == ["monatools"]
    assert got["S2-3"].nw == ["fine", "1", "2", "uvre"] and got["S2-3"].aw == ["hill"]
    assert got["S2-4"].nw == ["acme", "tools"] and got["S2-5"].nw == []
    assert got["S2-7"].nw == ["new", "co"] and got["S2-7"].alias == ["old", "llc"]
    assert got["S2-8"].nw == ["bharat", "tools"]


def test_synonyms_and_places(spark):
    rows = [("S2-1", "a", "Door 5 New Bombay Road, Calcutta", "India"), ("S2-2", "a", "Main Street, Ohio", "US"), ("S2-3", "a", "Calcutta", "US")]
    d = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    got = {r.entity_id: r.aw for r in normalize.normalise(d, synonyms={"main": ["high"], "new": ["nova"]}, country_synonyms={"US": {"ohio": ["oh"]}, "India": {"road": ["marg"]}}, places=True).collect()}
    assert got["S2-1"] == ["new", "bombay", "road", "calcutta", "mumbai", "kolkata", "navimumbai", "nova", "marg"]
    assert got["S2-2"] == ["main", "street", "ohio", "high", "oh"] and got["S2-3"] == ["calcutta"]
    vocab = spark.createDataFrame([("US", "ab", 3), ("US", "c", 1), ("France", "de", 1)], "country string, token string, n long")
    assert normalize.word_logp(vocab) == {"US": {"ab": pytest.approx(-0.2876820724517809)}, "France": {"de": 0.0}}
    with pytest.raises(ValueError):
        normalize.word_logp(vocab, most=2)


def test_string_similarities():
    assert strsim.ratio("", "") == 100
    assert strsim.ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert strsim.token_set("a b c", "b a") == 100
    assert strsim.partial("abc", "xxabcxx") == 100
    assert strsim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert strsim.lcs(a, b) == best[-1, -1]


def test_expected_f_is_brute_force():
    rng = np.random.default_rng(2)
    p = -np.sort(-rng.random((20, 5)), axis=1)
    got = decide.expected_f(p)
    for row, f in zip(p, got):
        for k in range(6):
            total = 0.0
            for labels in itertools.product((0, 1), repeat=5):
                w = np.prod([q if y else 1 - q for q, y in zip(row, labels)])
                tp, nt = sum(labels[:k]), sum(labels)
                total += w * (1.0 if k == nt == 0 else 0.0 if tp == 0 else 1.25 * tp / (0.25 * nt + k))
            assert f[k] == pytest.approx(total)
    assert decide.expected_f(np.array([[0.95, 0.9, 0.2], [0.05, 0.02, 0]])).argmax(axis=1).tolist() == [2, 0]


def test_decisions_and_metric(spark):
    d = spark.createDataFrame([("S1-a", "S2-x", 0.9), ("S1-b", "S2-x", 0.9), ("S1-b", "S3-y", 0.3)], "s1 string, r string, p double")
    assert {r.s1: round(r.q, 6) for r in decide.exclusive_posterior(d).filter("r = 'S2-x'").collect()} == {"S1-a": round(9 / 19, 6), "S1-b": round(9 / 19, 6)}
    assert [(r.s1, r.r) for r in decide.one_owner(d).orderBy("r").collect()] == [("S1-a", "S2-x"), ("S1-b", "S3-y")]
    truth = spark.createDataFrame([("S1-a", x) for x in "abc"], "s1 string, r string")
    pred = spark.createDataFrame([("S1-a", x) for x in "ac"], "s1 string, r string")
    qs = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1 string")
    rows = {r.s1: r.f for r in metrics.per_query(pred, truth, qs).collect()}
    assert rows["S1-a"] == pytest.approx(1.25 * 2 / (0.25 * 3 + 2)) and rows["S1-b"] == 1
    grid = {(r.t1, r.t2): r.f for r in decide.tune(pred.withColumn("p", F.lit(0.7)), truth, qs, [(0.5, 0.5), (0.9, 0.9)]).collect()}
    assert grid[0.5, 0.5] == pytest.approx((rows["S1-a"] + 1) / 2) and grid[0.9, 0.9] == pytest.approx(0.5)


def test_relations(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    rel = lambda a, b: one(spark, blocking.number_relation(arr(*a), arr(*b)))
    assert [rel(a, b) for a, b in ((["5"], []), (["5"], ["5"]), (["5", "6"], ["6"]), (["5", "6"], ["6", "7"]), (["5658"], ["658"]), (["5"], ["6"]))] == ["missing", "equal", "subset", "overlap", "trunc", "disjoint"]
    house = lambda a, b: one(spark, features.house_relation(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert [house(*x) for x in (("7", "7"), ("5658", "658"), ("100", "110"), ("1500", "1900"), ("1", "900"), (None, "1"), ("5", "58"), ("", "1"))] == [0, 1, 2, 3, 4, 5, 1, 5]


def test_cutoff_rules(spark):
    d = spark.createDataFrame([(0, 0.6, 9, None, None), (5, 0.1, 9, None, 30), (5, 0.1, 1, None, None)], "house_rel int, sk_jacc double, sc_rank int, nm_tset double, erk int")
    d = d.select("*", F.lit(0.0).alias("ad_tset"), F.lit(False).alias("noaddr_r"), F.lit(5).alias("num_rel"))
    assert [r.x for r in d.select(features.cutoff_mask(2).alias("x")).collect()] == [True, False, True]


def test_normalise_and_blocking_do_not_depend_on_order(spark):
    rows = [(f"S2-{i}", n, a, "US") for i, (n, a) in enumerate([("Acme Tools LLC", "12 Oak St, Dayton"), (None, None), ("Acme Tools", "None"), ("Bolt & Nut Inc", "7th Park Road")])]
    d = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    n = normalize.normalise(d)
    got = {r.entity_id: r for r in n.collect()}
    assert got["S2-0"].core == ["acme", "tools"] and got["S2-0"].aw == ["oak", "street", "dayton"] and got["S2-0"].ad == ["12"]
    assert got["S2-1"].noaddr and got["S2-2"].noaddr and got["S2-1"].nw == []

    def run(x):
        ix = blocking.tokens(x)
        found = blocking.pool(blocking.retrieve(blocking.tokens(x, query=True), ix, blocking.idf(ix, x)))
        return sorted(map(str, found.collect()))

    assert run(n) == run(normalize.normalise(d.repartition(3).orderBy(F.rand(1))))


def test_lexicon_and_oov(spark):
    pairs = spark.createDataFrame([(["राम", "x"], ["ram", "x"])] * 3, "a array<string>, b array<string>")
    assert {(r.indic, r.latin, r.n) for r in artifacts.indic_lexicon(pairs).collect()} == {("राम", "ram", 3), ("x", "x", 3)}
    vocab = spark.createDataFrame([("US", "ram", 5)], "country string, token string, n long")
    words = spark.createDataFrame([("राम",)], "indic string")
    assert artifacts.oov_map(words, vocab).first().how == "skeleton"


def test_submission(spark, tmp_path):
    m = spark.createDataFrame([("S1-a", "S2-x")], "s1 string, r string")
    q = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1 string")
    rec = spark.createDataFrame([("S2-x",)], "entity_id string")
    io.write_submission(m, m, q, rec, str(tmp_path / "m"), str(tmp_path / "c"))
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).collect()]
    assert sorted(rows, key=str) == [("S1-a", "S2-x"), ("S1-b", None)]
    with pytest.raises(ValueError):
        io.write_submission(m.withColumn("r", F.lit("S1-q")), m, q, rec, str(tmp_path / "m2"), str(tmp_path / "c2"))


def test_models(spark):
    rows = [(f"S1-{i}", f"S2-{i}", float(i % 10), None if i % 7 == 0 else float(i % 3), int(i % 10 > 5)) for i in range(400)]
    d = spark.createDataFrame(rows, "s1 string, r string, a double, b double, y int")
    got = model.predict(model.fit_matcher(d, ["a", "b"], iterations=5, depth=3), d, ["a", "b"])
    assert model.auc(got) > 0.95 and got.count() == 400


def test_entry_without_extras():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "block_pool" in e.queries()


def test_registered_index_is_whole(spark, monkeypatch):
    import math
    from collections import Counter, defaultdict

    from tessera import catalog

    cols = "entity_id string, business_name string, business_address string, country string, k long"
    recs = [(f"S2-{i:03d}", f"common {WORDS[i % 7]}{WORDS[i // 7 % 70]}", None if i % 5 == 0 else f"{100 + i} Oak Street, apt 4b", "US", i) for i in range(450)]
    asked = [(f"S1-{i:03d}", *recs[i][1:]) for i in range(0, 450, 45)]
    monkeypatch.setattr(catalog.FX, "records", lambda *_: spark.createDataFrame(recs, cols))
    monkeypatch.setattr(catalog.FX, "s1", lambda *_: spark.createDataFrame(asked, cols))
    found = catalog.queries()
    index = {(x.arm, x.t): (x.df, x.idf) for x in found["block_index"](spark, "").collect()}
    assert index[0, "n:common"][0] == 450 and (0, "u:apt4b") in index and {arm for arm, _ in index} == set(blocking.CAPS)

    own = defaultdict(set)
    for x in blocking.tokens(catalog._nrec(spark, "")).collect():
        own[x.arm, x.t].add(x.id)
    want = {k: (len(v), round((math.log(450) - math.log(len(v))) * 1024)) for k, v in own.items() if len(v) <= (200 if k[0] == 4 else 2000)}
    assert index == want
    score = Counter()
    for x in blocking.tokens(catalog._nq(spark, ""), query=True).collect():
        for r in own[x.arm, x.t] if (x.arm, x.t) in want else ():
            score[x.id, x.arm, r] += want[x.arm, x.t][1]
    by = defaultdict(list)
    for (s1, arm, r), sc in score.items():
        by[s1, arm].append((-sc, r))
    rows = {(s1, r, arm, -sc, rk) for (s1, arm), v in by.items() for rk, (sc, r) in enumerate(sorted(v)[: blocking.CAPS[arm]], 1)}
    assert rows == {(x.s1, x.r, x.arm, x.sc, x.rk) for x in found["block_retrieve"](spark, "").collect()}
    assert {(s1, r) for s1, r, *_ in rows} == {(x.s1, x.r) for x in found["block_pool"](spark, "").collect()}


def test_registered_fold_and_matcher_are_whole(spark, tmp_path, monkeypatch):
    import hashlib

    from tessera import catalog

    texts = {1: ("Ёлка ﬁn ½ Ａé", "елка fin 1⁄2 ae"), 2: ("ÀB 中文", "ab 中文"), 3: (None, "")}
    spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.folded for r in catalog.queries()["text_fold_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(want.encode()).hexdigest() for i, (_, want) in texts.items()}

    asked = []
    monkeypatch.setattr(catalog.model, "fit_matcher", lambda *a, **kw: asked.append((len(a), kw)))
    monkeypatch.setattr(catalog.model, "predict", lambda m, d, cols: d.withColumn("p", F.lit(0.5)))
    catalog.queries()["matcher"](spark, "/root/testdata/sf0.001")
    assert asked == [(2, {})]  # default trees and depth


def test_written_list_and_its_rules(spark, tmp_path):
    m = spark.createDataFrame([("S1-a", "S2-x"), ("S1-a", "S3-y")], "s1 string, r string")
    q = spark.createDataFrame([("S1-a",), ("S1-b",)], "s1 string")
    rec = spark.createDataFrame([("S2-x",), ("S3-y",)], "entity_id string")
    path = str(tmp_path / "m.tsv")
    io.write_submission(m, m, q, rec, path, str(tmp_path / "c.tsv"), one_file=True)
    with open(path) as f:
        assert f.read() == "source1_entity_id\tmatched_entity_ids\nS1-a\tS2-x,S3-y\nS1-b\t\n"
    rules = lambda p: {r.rule: r.n for r in io.file_violations(spark, p, "matched_entity_ids", q, rec).collect() if r.n}
    assert rules(path) == {}
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-a\tS2-x,S2-x,S1-z,S9-q,S2-none\nS1-a\t\nno tab here\nS1-c\tS3-y\n")
    assert rules(str(bad)) == {"no_tab": 1, "duplicate_row": 1, "duplicate_id": 1, "self_match": 1, "wrong_prefix": 1, "missing_query": 1, "unknown_query": 1, "unknown_record": 1}
    bad.write_text("source1_entity_id,matched_entity_ids\nS1-a,S2-x\n")
    assert rules(str(bad)) == {"comma_separated": 1, "no_tab": 1, "missing_query": 2}
    bad.write_text("source1_entity_id\twrong\nS1-a\tS2-x\nS1-b\t\n")
    assert rules(str(bad)) == {"header": 1}
    io.write_metrics(rec, str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text() == "entity_id\nS2-x\nS3-y\n"
    io.write_by(m, str(tmp_path / "by"), "r")
    assert spark.read.parquet(str(tmp_path / "by")).count() == 2


def test_record_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.tsv").write_text(f'entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-{i}\tA "quoted" name\t\tUS\n')
    got = io.read_records(spark, str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")).orderBy("entity_id").collect()
    assert [(r.entity_id, r.business_name, r.business_address) for r in got] == [(f"S2-{i}", 'A "quoted" name', None) for i in (1, 2)]


def test_head_levels_and_saved_models(spark, tmp_path):
    rows = [(f"S1-{i:03d}", f"S2-{i:03d}{j}", round(0.9 - 0.3 * j if i % 2 else 0.2 + 0.1 * j, 3), float(i % 2), int(i % 2 and j == 0)) for i in range(300) for j in range(3)]
    d = spark.createDataFrame(rows, "s1 string, r string, p double, nm_tset double, y int")
    truth = d.filter("y = 1").select("s1", "r")
    head = model.fit_head(d, truth, iterations=4, depth=2)
    h = {r.s1: r.h for r in model.head_scores(head, d).collect()}
    assert h["S1-001"] > 0.9 > 0.1 > h["S1-000"]
    got = {(r.s1, r.r) for r in decide.decide(d, {"rule": "head"}, model.head_scores(head, d)).collect()}
    assert ("S1-001", "S2-0010") in got and not any(s == "S1-000" for s, _ in got)
    with pytest.raises(ValueError):
        decide.decide(d, {"rule": "head"})
    level = model.fit_level(d, ["p", "nm_tset"], iterations=4, depth=2)
    better = model.predict(level, d, ["p", "nm_tset"], "p2").drop("p").withColumnRenamed("p2", "p")
    take, gain = model.gated(d.withColumn("p", F.lit(0.6)), better, lambda x: decide.rank_threshold(x, 0.5, 0.5), truth, 0.002)
    assert take and gain > 0.2 and model.gated(d, d, lambda x: decide.rank_threshold(x, 0.5, 0.5), truth, 0.001) == (False, 0.0)
    model.save(level, {"t1": 0.8, "rule": "rank"}, str(tmp_path / "m"))
    again, cfg = model.load(spark, str(tmp_path / "m"))
    assert cfg == {"rule": "rank", "t1": 0.8}
    assert sorted(map(str, model.predict(again, d, ["p", "nm_tset"], "p2").collect())) == sorted(map(str, model.predict(level, d, ["p", "nm_tset"], "p2").collect()))
    judged = d.withColumn("lg", F.when(F.col("nm_tset") > 0, F.lit(2.0)).when(F.col("s1") != "S1-002", F.lit(-2.0)))
    out = {(r.s1, r.r): r for r in model.blend(model.blended(judged, ["lg"]), judged, ["lg"]).collect()}
    assert out["S1-001", "S2-0010"].p > 0.5 > out["S1-000", "S2-0000"].p and out["S1-002", "S2-0020"].p == 0.2 and out["S1-002", "S2-0020"].lg is None
    assert features.feature_columns(d) == ["nm_tset"] and model.sampled(d, "r", 7).count() == 7


def test_street_twins(spark):
    rows = [(f"S2-{i}", "N", f"{100 + i} Oak{chr(97 + i)} Street, Dayton", "US") for i in range(8)] + [("S2-x", "N", None, "US"), ("S2-y", "N", "No number", "US")]
    rec = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(8)], "s1 string, r string")
    got = model.street_twins(pairs, rec, 5).collect()
    by = {r[0]: r[2] for r in rows}
    assert 1 <= len(got) <= 5
    for t in got:
        assert t.entity_id == "S2-SYN" + t.r[3:] and t.business_address != by[t.r] and t.business_address.split()[0] == by[t.r].split()[0] and t.business_address.endswith(", Dayton")


def test_pool_policies(spark):
    rows = [("q", "a", 10, "g1", "disjoint", False, 0.0), ("q", "b", 8, "g2", "equal", False, -0.9), ("q", "c", 3, None, "equal", False, 0.0), ("q", "d", 9, "g1", "disjoint", False, 0.0), ("q", "e", 7, "g3", "disjoint", True, 0.0)]
    d = spark.createDataFrame(rows, "s1 string, r string, sc long, gid string, rel string, a4 boolean, rev_margin double")
    from tessera.operators import candidates

    kept = lambda **p: {x.r for x in candidates.apply_policy(d, p).collect()}
    assert kept() == set("abcde") and kept(gate=True) == set("bce") and kept(alpha=0.75) == set("abd") and kept(groups=1) == set("ad")
    assert kept(beta=0.5) == set("acde") and kept(beta=-1) == set("abcde") and kept(kmax=2) == set("ad")
    truth = spark.createDataFrame([("q", "b"), ("z", "b")], "s1 string, r string")
    qs = spark.createDataFrame([("q",), ("z",)], "s1 string")
    got = {r.name: r for r in candidates.frontier(d, truth, qs, [{"name": "all"}, {"name": "gate", "gate": True}, {"name": "one", "groups": 1}]).collect()}
    assert (got["all"].recall, got["all"].complete, got["all"].cands) == (0.5, 0.5, 2.5) and got["one"].complete == 0 and got["gate"].best and not got["all"].best


def test_stream_of_records(spark, tmp_path):
    from tessera.streaming import live

    cols = "entity_id string, business_name string, business_address string, country string"
    qs = normalize.normalise(spark.createDataFrame([("S1-a", "Acme Tools", "12 Oak Street", "US"), ("S1-b", "Bolt Works", "7 Elm Road", "US")], cols))
    spark.createDataFrame([("S2-x", "Acme Tools LLC", "12 Oak St", "US"), ("S2-y", "Other Name", "99 Far Lane", "US")], cols).write.json(str(tmp_path / "in"))
    got = []
    run = live.match_stream(spark.readStream.schema(cols).json(str(tmp_path / "in")), blocking.tokens(qs, query=True), qs, lambda pairs, epoch: got.extend(pairs.collect()))
    run.start().awaitTermination(60)
    assert {(r.s1, r.r) for r in got} == {("S2-x", "S1-a")}


def test_blocks_of_queries_score_as_one_by_one(spark, monkeypatch):
    """Ties, scores of zero, ids in two countries and several blocks; ranks and lowest df of true pairs."""
    monkeypatch.setattr(blocking, "BLOCK", 3)
    import random

    rnd = random.Random(5)
    side = lambda kind, n: [(c, f"{kind}{i}", arm, f"t{rnd.randrange(9)}") for i in range(n) for arm in (0, 3) for c in (("US", "FR") if i % 5 == 0 else ("US",)) for _ in range(3)]
    ask, have = sorted(set(side("q", 10))), sorted(set(side("r", 25)))
    cols = "country string, id string, arm int, t string"
    df = {}
    for c, _, arm, t in have:
        df[c, arm, t] = df.get((c, arm, t), 0) + 1
    weight = {k: (v, 0 if k[2] == "t3" else 100 // v) for k, v in df.items() if k[2] != "t5"}
    w = spark.createDataFrame([(*k, *v) for k, v in weight.items()], "country string, arm int, t string, df long, idf long")
    hits = {}
    for c, q, arm, t in ask:
        for c2, r, arm2, t2 in have:
            if (c, arm, t) == (c2, arm2, t2) and (c, arm, t) in weight:
                hits.setdefault((q, arm), {}).setdefault(r, []).append(weight[c, arm, t])
    want = {(q, r, arm, s, k) for (q, arm), d in hits.items() for k, (s, r) in enumerate(sorted((-sum(i for _, i in v), r) for r, v in d.items())[: 4 if arm else 30], 1)}
    x, y = spark.createDataFrame(ask, cols), spark.createDataFrame(have, cols)
    assert {(p.s1, p.r, p.arm, -p.sc, p.rk) for p in blocking.retrieve(x, y, w, {0: 30, 3: 4}).collect()} == want
    assert any(s == 0 for *_, s, _ in want)
    merged = {}
    for (q, _), d in hits.items():
        for r, v in d.items():
            merged.setdefault(q, {}).setdefault(r, []).extend(v)
    top = {(q, r, s, k) for q, d in merged.items() for k, (s, r) in enumerate(sorted((-sum(i for _, i in v), r) for r, v in d.items())[:5], 1)}
    assert {(p.s1, p.r, -p.sc, p.rk) for p in blocking.best(x, y, w, 5).collect()} == top

    def pick(arm, sc, shared, low, true):
        return true, {"n": shared[true], "low": low(true)}

    truth = spark.createDataFrame([("q1", "r2"), ("q1", "r3"), ("q5", "r5"), ("q5", "none"), ("none", "r1")], "s1 string, r string")
    got = {(p.s1, p.r, p.arm, p.n, p.low) for p in blocking.scored(x, y, w, pick, {"n": "long", "low": "long"}, truth=truth).collect()}
    assert got == {(q, r, arm, len(d[r]), min(n for n, _ in d[r])) for (q, arm), d in hits.items() for r in d if (q, r) in {("q1", "r2"), ("q1", "r3"), ("q5", "r5")}} and got


def test_name_scores_are_exact_and_do_not_cut_each_window_out(monkeypatch):
    """All windows of a partial ratio in one alignment: no call for each; scores as by definition."""
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    r = random.Random(11)
    word = lambda k: "".join(r.choice("ab é") for _ in range(r.randrange(k)))
    pairs = [(word(9), word(14)) for _ in range(400)]
    rate = lambda a, b: 200.0 * plain(a, b) / (len(a) + len(b)) if a or b else 100.0
    for a, b in pairs:
        assert strsim.ratio(a, b) == rate(a, b)
        s, t = sorted((a, b), key=len)
        if s:
            assert strsim.partial(a, b) == max(rate(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))
        x, y = set(a.split()), set(b.split())
        if x and y and not (x & y and (x <= y or y <= x)):
            both = " ".join(sorted(x & y))
            xa, yb = (" ".join(filter(None, (both, " ".join(sorted(d))))) for d in (x - y, y - x))
            assert strsim.token_set(a, b) == max([rate(xa, yb)] + ([rate(both, xa), rate(both, yb)] if both else []))
    calls = []
    monkeypatch.setattr(strsim, "ratio", lambda a, b: calls.append(1) or 0.0)
    assert strsim.partial("acme tools", "the acme toys and tools company") > 70 and not calls


def test_matcher_computes_its_features_once(spark, monkeypatch):
    from tessera import catalog

    seen = []
    monkeypatch.setattr(catalog.model, "fit_matcher", lambda d, cols: seen.append(d))
    monkeypatch.setattr(catalog.model, "predict", lambda fitted, d, cols: seen.append(d) or d.withColumn("p", F.lit(0.5)))
    catalog.queries()["matcher"](spark, "/root/testdata/sf0.001")
    fitted, read = seen
    assert fitted is read and "Join" not in fitted._jdf.queryExecution().optimizedPlan().toString()


def test_queries_that_ask_alike_are_scored_once(spark):
    import time

    cols = "country string, id string, arm int, t string"
    ask = spark.createDataFrame([("US", f"q{i}", 0, t) for i in range(4) for t in ("a", "b")] + [("US", "q9", 0, "b"), ("US", "q3", 0, "unknown")], cols)
    have = spark.createDataFrame([("US", "r1", 0, "a"), ("US", "r1", 0, "b"), ("US", "r2", 0, "b")], cols)
    w = spark.createDataFrame([("US", 0, "a", 1, 7), ("US", 0, "b", 2, 3)], "country string, arm int, t string, df long, idf long")

    def pick(arm, sc, shared, low, true):
        import numpy as np

        return np.arange(len(sc)), {"sc": sc, "at": np.full(len(sc), time.perf_counter_ns())}

    got = blocking.scored(ask, have, w, pick, {"sc": "long", "at": "long"}).collect()
    assert {(x.s1, x.r, x.sc) for x in got} == {(f"q{i}", r, sc) for i in range(4) for r, sc in (("r1", 10), ("r2", 3))} | {("q9", "r1", 3), ("q9", "r2", 3)}
    assert len({x.at for x in got if x.s1 != "q9"}) == 1


def test_stored_records_give_what_tokens_give(spark, monkeypatch):
    """Names that many have, an id twice, null texts; each distinct text is worked on once."""
    cols = "entity_id string, business_name string, business_address string, country string"
    text = lambda i: (f"Acme {WORDS[i % 3]} LLC", None if i % 4 == 0 else f"{100 + i % 5} Oak Street", "US" if i % 6 else None)
    recs = spark.createDataFrame([(f"S2-{i:02d}", *text(i)) for i in range(30)], cols)
    asked = spark.createDataFrame([(f"S1-{i % 7}", *text(i)) for i in range(9)] + [(None, *text(1))], cols)
    plain_q, plain_r = normalize.normalise(asked), normalize.normalise(recs)
    q, r = normalize.normalise_once(asked), normalize.normalise_once(recs)
    rows = lambda d, names: sorted(map(repr, d.select(*names).collect()))
    assert rows(r, plain_r.columns) == rows(plain_r, plain_r.columns) and rows(q, plain_q.columns) == rows(plain_q, plain_q.columns)
    ix = blocking.tokens(plain_r)
    want = blocking.retrieve(blocking.tokens(plain_q, True), ix, blocking.idf(ix, plain_r))
    got = blocking.unpacked(blocking.retrieve_records(q, r))
    names = ["s1", "r", "arm", "sc", "rk"]
    assert rows(got, names) == rows(want, names) and want.count()
