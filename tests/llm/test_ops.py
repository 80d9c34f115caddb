import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op1_secrets as o1
from tessera.llm import op2_neardup as o2
from tessera.llm import op3_decontam as o3
from tessera.llm import op4_html as o4
from tessera.llm import op5_simple8b as o5
from tessera.llm import op6_quality as o6
from tessera.llm import op7_chat as o7
from tessera.llm import op8_bpe as o8
from tessera.llm import op9_topk as o9
from tessera.llm import op10_shards as o10

DOC = "doc_id long, text string, id string, key string, shard int"  # with names that the operators use themselves


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOC)


WORDS = [f"word{i}" for i in range(400)]
EDGE = [None, "", " ", "a", "Ünï çødé 🙂", "x" * 50_000, "same text here", "same text here"]


def test_secrets(spark):
    key = "AKIA" + "Q1" * 8
    rnd = "9fK2xLq8Zp0VtR4mWc7YbN1d"
    texts = [*EDGE, f'é token = "{"ab12" * 5}" and {key}', f"see {rnd} ok", "id 123e4567-e89b-12d3-a456-426614174000", 'Api_Key:"short" PASSWD=abcdefghijkl']
    got = {r.doc_id: r for r in o1.scan(docs(spark, texts)).select("doc_id", o1.joined(F.col("base")).alias("base"), o1.joined(F.col("spans")).alias("spans"), o1.redacted(F.col("text"), F.col("spans")).alias("red")).collect()}
    assert len(got) == len(texts)
    assert got[8].base == f"assign:2:31,hex:11:31,access:{texts[8].index(key)}:{len(texts[8])}" and "AKIA" not in got[8].red
    assert got[9].base == "" and got[9].spans == "entropy_base64:4:28" and got[9].red == "see [SECRET] ok"
    assert got[10].spans == "" and got[11].base == "assign:16:35"
    assert got[0].red == "" and got[5].red == texts[5]


def test_secret_joined_to_a_base_span(spark):
    rnd = "fK2xLq8Zp0VtR4mWc7YbN1dGh3"
    key = "AKIA" + "Q1" * 8
    hexes = "3f9a1c7be2d804561f0c9ab27e5d3846"
    texts = [f"id 745102938475610293-{rnd} ok", f"{key}/{rnd}.", f"{rnd}_{'7451029384756102'} {hexes}", f"token={hexes}"]
    rows = o1.scan(docs(spark, texts)).select("doc_id", "base", "spans", o1.joined(F.col("spans")).alias("at"), o1.redacted(F.col("text"), F.col("spans")).alias("red"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].base[0].kind == "hex" and got[0].red == "id [SECRET] ok"
    assert {s.kind for s in got[1].spans} == {"access", "entropy_base64"} and got[1].red == "[SECRET]."
    assert rnd[8:] not in got[2].red and got[2].red.endswith(" [SECRET]")
    assert got[3].at == "assign:0:38,hex:6:38"  # covered wholly by base spans


def base_of(text):
    """Base spans by ``re``: kind, start, end by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return ",".join(f"{o1.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_of_a_whole_table(spark):
    rng = np.random.default_rng(16)
    bits = ["password", "API_key", "apikey", "Token", "=", ": ", "'", '"', " ", "AKIA", "AKIAQ1W2E3R4T5Y6U7", "0123456789abcdef", "abcdef", "deadbeef", "Zz_9.-+/", "é🙂", "K", "ſecret", "\n"]
    odd = ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(400)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, odd[0]), (10_000, odd[0]), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.b) for r in o1.scan(d).select("doc_id", "text", o1.joined(F.col("base")).alias("b")).collect())
    assert got == sorted((str(i), t or "", base_of(t)) for i, t in rows)
    assert not o1.scan(d.limit(0)).collect()


def test_many_secrets_in_one_text(spark):
    n = 3000
    text = " ".join(f"{i:016x}" for i in range(n))
    r = o1.scan(docs(spark, [text])).select("base", o1.redacted(F.col("text"), F.col("spans")).alias("red")).first()
    assert [(s.start, s.end) for s in r.base] == [(17 * i, 17 * i + 16) for i in range(n)] and r.red == " ".join(["[SECRET]"] * n)


def test_entropy_is_recomputed_entropy(spark):
    rng = np.random.default_rng(3)
    cls = o1.CLASSES[1]
    vals = ["".join(rng.choice(list(cls.symbols[:n]), 60)) for n in (8, 20, 30, 66)]
    rows = spark.createDataFrame([(v,) for v in vals], "v string").select("v", o1.hot_windows(F.col("v"), cls).alias("s")).collect()
    for v, s in rows:
        mark = set()
        for i in range(len(v) - cls.window + 1):
            w = v[i : i + cls.window]
            c = np.array([w.count(x) for x in set(w)])
            if -(c / len(w) * np.log2(c / len(w))).sum() >= cls.min_bits - 1e-9:
                mark |= set(range(i, i + cls.window))
        assert mark == {k for a, b in s for k in range(a, b)}


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(WORDS, 150)) for _ in range(6)]
    texts = list(EDGE)
    for b in base:
        w = b.split()
        w[70] = "changed"
        texts += [b, b, b.upper() + "!", " ".join(w)]
    hot = " ".join(rng.choice(WORDS, 150)).split()
    for i in range(40):  # a large group of near copies
        w = list(hot)
        w[int(rng.integers(150))] = f"edit{i}"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in o2.near_duplicates(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert got[0].class_id == got[1].class_id and got[6].class_id == got[7].class_id == 6
    for k in range(6):
        assert {got[8 + 4 * k + j].class_id for j in range(4)} == {8 + 4 * k}
    assert {got[i].class_id for i in range(32, 72)} == {32} and sum(got[i].kept for i in range(32, 72)) == 1
    assert len({got[i].class_id for i in (3, 4, 5, 8, 12, 16)}) == 6
    assert o2.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_of_four_and_five_kmers(spark):
    texts = []
    for i in range(20):
        w = WORDS[9 * i : 9 * i + 9]
        assert o2.similarity(w[:8], w, 0.8) == o2.similarity(w[1:], w, 0.8) == pytest.approx(8 / 9)
        texts += [" ".join(w[1:] if i % 2 else w[:8]), " ".join(w)]
    got = {r.doc_id: r.class_id for r in o2.near_duplicates(docs(spark, texts)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(20)) >= 17  # 0.97 of the pairs on average


def test_similarity_is_edit_similarity():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.choice(list("abcd"), rng.integers(0, 25)) for _ in "ab")
        if rng.random() < 0.5:
            b = np.delete(a, rng.integers(0, max(1, len(a)), 2) % max(1, len(a))) if len(a) else a
        t = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = min(t[i, j] + (x != y), t[i, j + 1] + 1, t[i + 1, j] + 1)
        s = 1 - t[-1, -1] / max(len(a), len(b), 1)
        assert o2.similarity(a, b) == pytest.approx(s)
        assert (o2.similarity(a, b, 0.7) >= 0.7 - 1e-9) == (s >= 0.7 - 1e-9)


def test_rare_runs_lose_no_pair():
    rng = np.random.default_rng(6)
    pairs = 0
    for _ in range(600):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        b = list(a)
        for _ in range(int(rng.integers(0, 0.2 * len(a) + 1))):
            at = int(rng.integers(0, len(b)))
            match rng.integers(3):
                case 0:
                    b[at] = np.uint64(99)
                case 1:
                    b.insert(at, np.uint64(98))
                case _ if len(b) > 1:
                    del b[at]
        a, b = sorted((a, np.array(b, dtype=np.uint64)), key=len, reverse=True)
        if o2.similarity(a, b, 0.85) < 0.85 - 1e-9:
            continue
        count = rng.integers(1, 60, 1 << 12)
        at = lambda g: count[(g & np.uint64(4095)).astype(int)]
        (tx, cx, sx), (ty, _, sy) = (o2.segments(g, [at(k) for k in g], rng_rare) for g, rng_rare in ((o2.grams_of(a), 20), (o2.grams_of(b), 20)))
        edits = int(0.15 * len(a) + 1e-9)
        ask = o2.chosen(tx, cx, sx, edits)
        if edits:
            assert len(ask) == edits + 1
        else:
            assert (a == b).all()
        assert not len(ask) or set(tx[ask].tolist()) & set(ty[sy > 0].tolist())
        pairs += 1
    assert pairs > 200


def test_near_duplicates_of_a_whole_table(spark):
    """All pairs of sf0.001: every pair of similarity 0.85 or more is in one class, and classes hold nothing else."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r.doc_id: np.array([hash(w) for w in re.findall(r"[^\W_]+", (r.text or "").lower())]) for r in d.collect()}
    got = {r.doc_id: r.class_id for r in o2.near_duplicates(d).collect()}
    ids = sorted(i for i in words if len(words[i]))
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    near = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if o2.similarity(words[i], words[j], 0.85) >= 0.85 - 1e-9]
    for i, j in near:
        up[max(top(i), top(j))] = min(top(i), top(j))
    differ = [(i, j) for i, j in near if len(words[i]) != len(words[j]) or (words[i] != words[j]).any()]
    assert len(differ) >= 10 and all(got[i] == top(i) for i in ids)


def test_open_members_of_a_bucket_meet(spark):
    """Texts that share a passage, in pairs of near copies beyond the hubs."""
    rng = np.random.default_rng(12)
    shared = list(rng.choice(WORDS, 30))
    texts = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(30)]
        texts += [" ".join(own[:15] + shared + own[15:]), " ".join(own[:15] + shared + own[15:29] + ["other"])]
    got = {r.doc_id: r.class_id for r in o2.near_duplicates(docs(spark, texts), sketches=64, ell=1).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(60))


def test_components(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r["class"] for r in o2.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(n + 1)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    """The driver keeps each job's plan and tasks: rounds of a dozen jobs each took its memory on check_h."""
    edges = spark.createDataFrame([(bytes([i, 255 - i]), bytes([i + 1, 254 - i])) for i in range(100)] + [(b"\xff", b"\xfe\x00")], "a binary, b binary").localCheckpoint()
    sc = spark.sparkContext
    sc.setJobGroup("few", "")
    few = o2.connected(edges)
    sc.setJobGroup("rest", "")
    got = {bytes(r.node): bytes(r["class"]) for r in few.collect()}
    assert got == {bytes([i, 255 - i]): bytes([0, 255]) for i in range(101)} | {b"\xff": b"\xfe\x00", b"\xfe\x00": b"\xfe\x00"}
    assert len(sc.statusTracker().getJobIdsForGroup("few")) <= 5
    for most in (0, 40):  # by rounds alone, and by rounds and then in one task
        monkeypatch.setattr(o2, "_LOCAL", most)
        assert {bytes(r.node): bytes(r["class"]) for r in o2.connected(edges).collect()} == got
    assert o2.connected(edges.limit(0)).count() == 0


def test_marks_leave_out_no_near_pair(spark):
    """Parities of word counts rule out texts that share most of their words and are not near, and no pair that is."""
    rng = np.random.default_rng(13)
    rows = []
    for k in range(400):
        a = rng.integers(-(2**31), 2**31, rng.integers(1, 200))
        b = list(a)
        for _ in range(int(rng.integers(0, 0.3 * len(a) + 1))):
            at, way = int(rng.integers(0, len(b))), rng.integers(3)
            b[at : at + (way != 1)] = rng.integers(-(2**31), 2**31, int(way < 2)).tolist()
            b = b or [0]
        near = o2.similarity(a, b, 0.85) >= 0.85 - 1e-9
        rows.append((near, len(a), o2.mark(a).tolist(), len(b), o2.mark(np.array(b)).tolist()))
    d = spark.createDataFrame(rows, "near boolean, m long, x array<long>, n long, y array<long>")
    x, y = ([d[c][i] for i in range(o2._MARK)] for c in "xy")
    got = d.select("near", o2._may_be_near(d.m, x, d.n, y, 0.85).alias("may")).collect()
    assert sum(r.near for r in got) > 100 and all(r.may for r in got if r.near)
    assert sum(r.may for r in got if not r.near) < 0.5 * sum(not r.near for r in got)


def brute(text, items, width=10):
    """What the query returns for one text, word by word."""
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    words, hit, ids = cut(text), set(), set()
    for item, t in items:
        own = cut(t)
        for i in range(max(1, len(own) - width + 1)) if own else ():
            w = own[i : i + width]
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_decontamination(spark, block):
    items = [(1, " ".join(WORDS[:12])), (2, "tiny one"), (3, None), (4, "!!!"), (5, " ".join(WORDS[5:15]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [*EDGE, "pre " + ", ".join(WORDS[:15]).upper() + " post", "a TINY... one b tiny one", " ".join(WORDS[:9])]
    got = {r.doc_id: r for r in o3.decontaminate(docs(spark, texts), bench, block_chars=block).collect()}
    for i, t in enumerate(texts):
        n, hit, k, digest, _ = brute(t, items)
        r = got[i]
        assert (r.n_words, len(r.hits), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == (n, hit, k, digest)
    assert [texts[9][s.start : s.end] for s in got[9].spans] == ["TINY... one", "tiny one"]


def test_decontamination_does_not_depend_on_blocks(spark):
    items = [("1", " ".join(WORDS[:12])), ("5", " ".join(WORDS[5:15])), ("6", " ".join(WORDS[15:18])), (None, "lost item"), (None, "tiny one"), ("7", "tiny one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(None, " ".join(WORDS[:18])), (None, "a tiny one"), (None, "clean"), (1, "a lost item"), (1, "a tiny one"), (1, "a tiny one"), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [sorted(map(str, o3.decontaminate(d, bench, block_chars=size, batch_bytes=n, wave_chars=wave).collect())) for size, n, wave in ((16 << 20, 1, 1 << 30), (100, 9, 1 << 30), (30, 1 << 20, 1 << 30), (1, 50, 3))]
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2] == got[3]
    by = {str(r.n_words): r for r in o3.decontaminate(d, bench, block_chars=30).collect() if r.doc_id is None}
    assert list(by["18"].hits) == list(range(18)) and [(s.start, s.end) for s in by["18"].spans] == [(0, len(rows[0][1]))] and by["18"]["items"] == ["1", "5", "6"]
    assert by["3"]["items"] == ["7", None] and not by["1"].hits


def test_blocks_hold_every_window():
    rng = np.random.default_rng(13)
    items = [(i, " ".join(rng.choice(WORDS, n))) for i, n in enumerate((1, 9, 10, 11, 200, 37, 500))] + [(8, ""), (9, None)]
    want = {(i, w) for i, t in items for w in o3.windows_of(o3.words_of(t), 10)}
    for size in (1, 100, 1000, 10_000, 1 << 20):
        blocks = list(o3._blocks(iter(items), 10, size))
        assert {(i, w) for b in blocks for i, t in b for w in o3.windows_of(o3.words_of(t), 10)} == want
        sizes = [sum(len(w) + 1 for _, t in b for w in o3.windows_of(o3.words_of(t), 10)) for b in blocks]
        assert max(sizes) <= max(size, 110)


def test_html(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p><b>One <i>two</i><br><p>three&nbsp; four<ul><li>x<li>y</ul><div class=comments><p>me too</div></article><footer>f</footer>"
    rows = [(0, "http://h.com/1", page), (1, "http://h.com/2", page.replace("T &amp;", "Z")), (2, None, None), (3, "odd", "plain <b>text</b> &lt;x&gt;"), (4, "http://h.com/3", "<p>unclosed <")]
    got = {r.id0: r.text for r in o4.extract(spark.createDataFrame(rows, "id0 long, url string, html string"), id_col="id0").collect()}
    assert got[0] == "T & U\n\nOne two\n\nthree four\n\nx\n\ny" and got[1].startswith("Z U") and got[2] == "" and len(got) == 5
    assert got[4].startswith("unclosed")


def test_html_attributes_and_wrappers(spark):
    article = "<article><p>Main text of the page</article>"
    wraps = [
        ("<body style='overflow:hidden'>", article), ('<body title="hidden gem" data-hidden=no>', article), ("<div class='has-sidebar'>", article), ("<div id=menu-content>", article),
        ("<div class='page has-sidebar'>", "<p>Main text of the page</div><p>x"), ("<div class='menu page'>", "<p>Main text of the page"), ("<div class='widget layout'>", "<main><p>Main text of the page</main></div>"),
    ]
    drops = ["<div hidden>", "<div class=x HIDDEN=''>", "<div aria-hidden=true>", '<div id="sidebar" width=9 data-video=y>', "<div class=related><article>", "<div class='a hidden' hidden><article>"]
    pages = [f"<html>{a}{b}" for a, b in wraps] + [f"<body>{article}{d}<p>other words</div>" for d in drops]
    rows = [(i, f"http://h{i}.com/1", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in o4.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith("Main text of the page") for i in range(len(pages)))
    for d in drops:  # on the whole page too
        page, _ = o4.read_page(f"<body><p>Main text{d}<p>other words</div>")
        assert o4.blocks(page, None) == ["Main text"]


def test_html_host_paths(spark):
    """Hosts of one template, of two, of none in common, and of one page; pages that differ from their host's templates."""
    words = lambda n, w: " ".join([w] * n)
    rows = []
    for i in range(30):  # two templates; of every tenth page the longest container is a list of links' texts
        main = "post" if i % 3 else "essay"
        more = f"<div class='teasers{i}'><p>{words(90, 'teaser')}</p></div>" if i % 10 == 0 else ""
        rows.append((i, f"https://two.example/{i}", f"<body><div class='wrap'><div class='{main}'><p>{words(40, 'main')}{i}</p></div>{more}</div></body>"))
    rows.append((30, "https://two.example/odd", f"<body><div class='wrap'><div class='letter'><p>{words(30, 'own')}</p></div></div>"))
    rows += [(40 + i, "https://none.example/", f"<body><div class='{x}{x}'><p>{x * 60}</p></div>") for i, x in enumerate("abc")]
    rows += [(50, "https://one.example/", f"<body><section><p>{words(20, 'alone')}</p></section>"), (51, "https://one.example:80/x", ""), (52, None, f"<p>{words(5, 'free')}"), (52, None, f"<p>{words(5, 'free')}")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    one = sorted((r.page_id, r.text) for r in o4.extract(d).collect())
    assert one == sorted((r.page_id, r.text) for r in o4.extract(d.repartition(3), broadcast_bytes=-1).collect())
    got = dict(one)
    assert all(got[i] == f"{words(40, 'main')}{i}" for i in range(30))
    assert got[30] == words(30, "own") and [got[40 + i] for i in range(3)] == [x * 60 for x in "abc"]
    assert got[50] == words(20, "alone") and got[51] == "" and [t for i, t in one if i == 52] == [words(5, "free")] * 2
    assert not o4.extract(d.limit(0)).collect()


def test_html_of_a_whole_table(spark):
    """The article of each page of sf0.001, cut out by its tags and plain replacements."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in o4.query(spark, "/root/testdata/sf0.001").collect()}
    seen = 0
    for r in rows:
        m = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        if not m or re.search(r"<(nav|aside|form|script|style|header|footer|div|section|!--)", m[1]):
            continue
        seen += 1
        parts = re.split(r"</?(?:p|h[1-6]|li|ul|ol|table|tr|td|th|blockquote|pre|figure|figcaption)\b[^>]*>", re.sub(r"<br[^>]*>", " ", m[1]))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)
    assert seen >= 10


def test_simple8b(spark, tmp_path):
    rng = np.random.default_rng(6)
    for n in (0, 1, 59, 60, 5000, 12345):
        for top in (1, 2, 300, 50_000, 2**61):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            chunk = o5.Chunk(o5.write_chunk([7], [ids]))
            assert (chunk.ids() == ids).all() and (n <= o5.BLOCK or (chunk.block(1) == ids[o5.BLOCK : 2 * o5.BLOCK]).all())
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(o5.default_path())
    texts = [*EDGE, "don't <|endoftext|> x", "½ ² a\x1cb\x85c  d\n\n e"]
    o5.write(docs(spark, texts), str(tmp_path / "t"), chunk_ids=50)
    start = 0
    for r in sorted(o5.digests(spark, str(tmp_path / "t")).collect()):
        ids = np.array([*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    o5.write_file(str(tmp_path / "f"), [o5.write_chunk([1, None], [np.arange(3, dtype=np.uint64)] * 2)])
    assert [d for c in o5.read_file(str(tmp_path / "f")) for d, _ in c.docs()] == [1, None]


def test_simple8b_of_a_whole_table(spark):
    """Every text of sf0.01 as the library encodes it whole."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(o5.default_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    start = 0
    for r in sorted(o5.query(spark, "/root/testdata/sf0.01").collect()):
        ids = np.array([*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_of_a_batch_are_those_of_the_pattern():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(17)
    lib = Tokenizer.from_file(o5.default_path())
    bits = ["'s", "'", "ll", "'re", " ", "  ", "\n", "\t", "a", "Word", "é", "ß", "12", "_", "-", "\0", "t", "'VE", "x" * 20, "×", "文", "Ʌ", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)]
    enc = o5.Encoder(o5.default_path(), cache_words=300)  # cleared now and then
    for a in range(0, len(texts), 100):
        for t, ids in zip(texts[a : a + 100], enc.encode(texts[a : a + 100], 0)):
            assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 0]


def test_simple8b_of_odd_rows(spark, tmp_path):
    d = spark.createDataFrame([(None, "b"), (3, "a a"), (3, "a"), (1, None)], "doc_id long, text string")
    o5.write(d, str(tmp_path / "t"))
    got = sorted(o5.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, len(r.ids)) for r in got] == [(None, 2), (1, 1), (3, 2), (3, 3)] and [r.start for r in got] == [0, 2, 3, 5]
    o5.write(d.limit(0), str(tmp_path / "e"))
    assert not o5.digests(spark, str(tmp_path / "e")).collect()


def test_random_indexing_sums(spark):
    """Context sums and counts of a small corpus, neighbour by neighbour."""
    texts = ["a b, c", "b B\nd", None, "", "x", "a b, c"]
    places, signs = o6.index_vectors()
    want = np.zeros((o6.BUCKETS, o6.DIMS + 1), dtype=np.int64)
    for t in texts:
        tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+|\n", t or "")
        for line in ([zlib.crc32(x.lower().encode()) % o6.BUCKETS for x in tokens], [zlib.crc32(b"\0" + o6._shape(x).encode()) % o6.BUCKETS for x in tokens]):
            for i, c in enumerate(line):
                want[c, o6.DIMS] += 1
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(line):
                        np.add.at(want[c], places[line[j]], signs[line[j]])
    assert (o6.corpus_vectors(docs(spark, texts).repartition(3)) == want).all()
    assert not o6.corpus_vectors(docs(spark, [])).any()


def test_quality_on_held_out_labels(spark):
    d = o6.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out and quality is not null").toPandas()
    p, y = d["score"].to_numpy(), d["quality"].to_numpy().astype(int)
    rank = d["score"].rank().to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()
    assert len(y) > 50 and auc > 0.85 and loss < 0.3 and ((p >= 0.3) == y).mean() > 0.93


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(18)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    aside = np.arange(3000) % 5 == 0
    net = o6.fit(x, y, aside, epochs=5)
    loss = lambda t: np.logaddexp(0, np.where(y[aside] == 1, -1, 1) * net.logits(x[aside]) / t).mean()
    assert loss(net.temperature) <= min(loss(net.temperature * f) for f in (0.8, 1.25)) + 1e-6


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, "good words here " * 5 if i % 2 else "!!! ### $$$", "x") for i in range(40)] + [(None, "a", "x"), (3, "good words", "x"), (3, "good words", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = o6.train(d, labels)
    got = o6.score(d, model).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 3}) <= 2 and [r.held_out for r in got if r.doc_id is None]
    assert not o6.score(d.limit(0), model).collect()


def test_quality(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(WORDS, 60)) if i % 2 else "!! ".join(w.upper() for w in rng.choice(WORDS, 60)) for i in range(400)]
    d = docs(spark, texts + EDGE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in o6.score(d, o6.train(d, labels)).collect()}
    assert len(got) == 408 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if i < 400 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert {r.score for r in o6.score(docs(spark, ["a"]), o6.train(docs(spark, ["a"]), labels.limit(0))).collect()} == {0.5}


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a<|im_sep|>\\<\\|x"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "r\\n\no\\le", "t\n")]
    d = o7.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in d.select("conv_id", "formatted", o7.read_turns(F.col("formatted")).alias("t"), o7.masked(F.col("formatted"), F.col("mask")).alias("l")).collect()}
    assert [tuple(x) for x in got[1].t] == [("user", rows[1][3]), ("assistant", "b"), ("assistant", "")] and list(got[1].l) == ["b", ""]
    assert got[1].formatted.count("<|im_start|>") == 2
    assert [tuple(x) for x in got[2].t] == [("", "")] and [tuple(x) for x in got[None].t] == [("r\\n\no\\le", "t\n")]


def test_chat_round_trip(spark):
    """Any roles and texts come back; the formatted string and the mask are those of a plain version."""
    rng = np.random.default_rng(15)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "\n", "\0", "<", "|", "<\\|", "s", "n", "assistant", "é🙂", ""]
    some = lambda n: "".join(rng.choice(bits, rng.integers(0, n)))
    rows = [(c, t, str(rng.choice(["assistant", "user", some(5)])), some(8), "x") for c in range(25) for t in range(int(rng.integers(1, 12)))]
    rows += [(99, t, "assistant" if t % 3 else "r\0\\x", f"t{t}", "y") for t in range(700)] + [(98, 0, "user", "same", "z")] * 2
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, blocks string")
    got = o7.format_chats(d).select("conv_id", "formatted", "mask", o7.read_turns(F.col("formatted")).alias("t"), o7.masked(F.col("formatted"), F.col("mask")).alias("l")).collect()
    assert len(got) == 27
    esc = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x)
    for r in got:
        own = sorted((x[1], x[2], x[3]) for x in rows if x[0] == r.conv_id)
        assert [tuple(x) for x in r.t] == [(b, c) for _, b, c in own]
        assert list(r.l) == [c for _, b, c in own if b == "assistant"]
        want, last = "", None
        for _, role, text in own:
            if role == last:
                want += "<|im_sep|>" + esc(text)
            else:
                want += ("" if last is None else "<|im_end|>\n") + "<|im_start|>" + esc(role.replace("\\", "\\s").replace("\n", "\\n")) + "\n" + esc(text)
            last = role
        assert r.formatted == want + "<|im_end|>\n" and sum(m.n for m in r.mask) == len(r.formatted)
    assert not o7.format_chats(d.limit(0)).collect()


def test_bpe_checks_the_file():
    with open(o8.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert o8.checked(spec) is spec
    for part, other in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("model", {**spec["model"], "byte_fallback": True})):
        with pytest.raises(ValueError, match=part):
            o8.checked({**spec, part: other})


def test_bpe_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b", "x"), (1, "same", "x"), (1, "same", "x"), (2, None, "x")], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), len(r.ids), r.decoded) for r in o8.encode(d).collect())
    assert [x[:2] for x in got] == [("1", 1), ("1", 1), ("2", 0), ("None", 2)] and got[2][2] == ""
    assert not o8.encode(d.limit(0)).collect()


def test_bpe(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(o8.default_path())
    texts = [*EDGE, "ΑΣ ΣΑΣ İstanbul ½²x", "don't I'LL\x1c\x85a", "é <|startoftext|><|endoftext|>x", "中文 a_b __ 12 34"]
    for r in o8.encode(docs(spark, texts)).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_topk(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(0, 0.2, (300, 8)), 2)
    v[40:60] = v[40]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 0), (901, [float("nan")] * 8, 0), (902, [None] * 8, 0)]
    got = o9.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int"), F.col("vec_id") % 20 == 0, k=7).collect()
    q = np.floor(64 * v).astype(int)
    for i in range(0, 300, 20):
        s = q @ q[i]
        want = [(j, s[j]) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:7]]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == want
    assert {r.query_id for r in got} == set(range(0, 300, 20))


def test_topk_of_repeated_queries_and_large_components(spark):
    rng = np.random.default_rng(14)
    v = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(70)]
    rows = list(enumerate(v)) + [(20, v[20]), (20, v[21]), (5, v[5])]  # a repeated query, one of equal id, a repeated candidate
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = o9.search(d, F.col("vec_id") % 20 == 0, k=6, block_rows=16).collect()
    q = [(i, (64 * np.array(x)).astype(int)) for i, x in rows]
    for i, row, own in ((0, 0, v[0]), (40, 0, v[40]), *((20, r, x) for r, x in enumerate(sorted((v[20], v[21]))))):
        want = sorted(((-int(w @ (64 * np.array(own)).astype(int)), j) for j, w in q if j != i))[:6]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if (r.query_id, r.query_row) == (i, row)] == want
    big = [(0, [2.0**40, 1.0]), (1, [2.0**40, -1.0]), (2, [2.0**20, 3.0]), (3, [-(2.0**40), 0.0]), (4, [1e300, 0.0])]
    got = o9.search(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, o9.MOST), (2, o9.MOST), (4, o9.MOST), (3, o9.LEAST)]
    small = [(0, [2.0**26, 1.0]), (1, [3.0, 5.0]), (2, [2.0**26, 0.0])]
    got = o9.search(spark.createDataFrame(small, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, o9.MOST), (1, 2**26 * 3 * 4096 + 5 * 4096)]
    assert not o9.search(d.limit(0), F.col("vec_id") == 0).collect()


def test_shards(spark):
    rng = np.random.default_rng(9)
    texts = ["hot " * 20] * 300 + [" ".join(rng.choice(WORDS, rng.integers(1, 80))) for _ in range(900)] + EDGE + ["pair of copies"] * 2
    d = docs(spark, texts)
    got = o10.assign(d, shards=6).collect()
    assert len(got) == len(texts)
    for k in range(6):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(str, o10.assign(d.repartition(5), shards=6).collect())) == sorted(map(str, got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by = {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        by.setdefault(t, set()).add(r.shard)
    assert len(by["pair of copies"]) == 1
    assert o10.assign(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.size) for r in o10.assign(odd, shards=2).collect()) == [("1", 8), ("1", 9), ("1", 9), ("None", 9), ("None", 9)]


def test_shards_of_a_whole_table_are_balanced(spark):
    got = o10.query(spark, "/root/testdata/sf0.01").collect()
    size, rows = np.zeros(24), np.zeros(24)
    for r in got:
        size[r.shard] += r.size
        rows[r.shard] += 1
    share = size.sum() / 24
    assert size.max() <= 1.05 * max(share, max(r.size for r in got)) and size.min() >= 0.93 * share and rows.min() >= 0.9 * rows.mean()


def test_pipeline(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    from tessera.llm._util import table

    sf = "/root/testdata/sf0.001"
    d = table(spark, sf, "documents")
    out = cp.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in d.select("doc_id").collect()}
    assert cp.secrets(spark, d, sf).columns == d.columns
    assert not [r for r in cp.secrets(spark, d, sf).collect() if re.search(r"AKIA[A-Z0-9]{14}", r.text)]


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(10)
    a, b, c, e = (" ".join(rng.choice(WORDS, 60)) for _ in range(4))
    leak = " ".join(WORDS[:12])
    rows = [(None, a, "x"), (None, b, None), (None, b, "x"), (7, a, "x"), (7, c, "x"), (7, c, "x"), (-3, c + " end", "x"), (None, f"{e} {leak}", "x"), (8, "clean words", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    read = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    order = lambda x: sorted(x, key=str)
    assert read(cp.quality(spark, d, str(tmp_path))) == order(rows)  # without labels every score is 0.5
    assert read(cp.decontaminate(spark, d, str(tmp_path))) == order(rows[:7] + rows[8:])
    got = read(cp.near_duplicates(spark, d, str(tmp_path)))
    assert [r[:2] for r in got] == order([(-3, c + " end"), (7, a), (8, "clean words"), (None, b), (None, rows[7][1])])


def test_row_keys_are_in_order_of_ids(spark):
    cp = pytest.importorskip("corpus_pipeline")
    ids = [-(2**63), -5, -1, 0, 3, 10, 2**63 - 1, None]
    got = cp.keyed(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), "k").orderBy("k").collect()
    assert [r.doc_id for r in got] == ids


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Empty tables, null and empty texts, long ones, repeated rows and clashing columns go through each stage."""
    cp = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, " ".join(WORDS[:12])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, "a", 0), (2, "", "a", 1), (3, "x" * 100_000, "b", 2), (3, "x" * 100_000, "b", 2), (4, " ".join(WORDS * 20), None, 3), (5, "id AKIA" + "Q1" * 8, "c", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row_key string, n_chars long").select("doc_id", "text", "row_key", "n_chars", F.lit("k").alias("key"), F.lit(True).alias("kept"), F.lit(1).alias("hits"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and not stage(spark, d.limit(0), str(tmp_path)).collect(), name
        assert len({r.doc_id for r in out.collect()}) == (4 if name in ("near_duplicates", "decontaminate") else 5), name
    assert cp.tokens(spark, d, str(tmp_path)).count() == 6


def test_quality_stage_drops_what_it_rejects(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(19)
    rows = [(i, " ".join(rng.choice(WORDS, 60)) if i % 2 else "!!! " * 40, "x") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.doc_id for r in cp.quality(spark, d, str(tmp_path)).collect()} == set(range(1, 300, 2))
