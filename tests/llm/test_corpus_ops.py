"""Operators across documents: against plain Python, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseflow.llm import jaccard, mixing, repeats, secrets, warc
from clauseflow.llm.components import components
from clauseflow.llm.scratch import materialize
from clauseflow.narrow import narrowed, parted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def copies(spark):
    """Exact and near copies, shared passages, short texts, repeated rows, nulls, one long text."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5)))
    base = [" ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 8, 11, 14, 30, 120]))) for _ in range(60)]
    passage = " ".join(word() for _ in range(45))
    rows = []
    for i, t in enumerate(base):
        rows.append(t)
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            ws = t.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                ws[r.randrange(len(ws))] = word()
            rows.append(("  " if r.random() < 0.3 else " ").join(ws).upper() if r.random() < 0.2 else " ".join(ws))
        if i % 5 == 0:
            rows.append(f"{word()} {passage} {word()} {passage} {word()}")
    rows += [None, "", " \n ", "one", "one", " ".join(word() for _ in range(20_000))]
    r.shuffle(rows)
    data = [(i, t, "en", "s") for i, t in enumerate(rows)]
    return data


def plain_sets(t, k):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def plain_components(data, k, percent):
    sets = {i: plain_sets(t, k) for i, t, *_ in data}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_against_all_pairs(spark, copies, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(spark.createDataFrame(copies, SCHEMA), k, percent).collect()}
    assert got == plain_components(copies, k, percent)


def test_jaccard_chains_hot_lists_and_parts(spark, monkeypatch):
    """Chains of near copies, and a phrase that all texts share; with tiny limits for parts, blocks and frequent shingles."""
    for name, value in (("LONG", 3), ("BLOCK", 4), ("HEAVY", 8), ("BUFFER", 50)):
        monkeypatch.setattr(jaccard, name, value)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        base = base[:-1] + [base[-1]] if i % 3 else [*base[2:], f"n{i}a", f"n{i}b"]
        rows.append((i, " ".join(base), "en", "s"))
    rows += [(100 + i, "common phrase of five words " + " ".join(f"u{i}x{j}" for j in range(3)), "en", "s") for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_components(rows, 4, 85)


def test_light_sets_meet_under_subsets():
    for percent in (60, 85):
        for s in range(1, 15):
            for t in jaccard.partners(s, 14, percent):
                o = jaccard.least_overlap(s, t, percent)
                x = np.arange(1, s + 1, dtype=np.uint64)
                y = np.concatenate((x[:o], np.arange(100, 100 + t - o, dtype=np.uint64)))
                if len(y) == t and s != t:
                    assert set(jaccard.subset_keys(x, 14, percent)) & set(jaccard.subset_keys(y, 14, percent))
    assert jaccard.boundary({}) >= 1 and jaccard.boundary({5: 1000, 20: 10}) >= 5


def test_jaccard_odd_rows(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", None, None), (3, "a b c d e", None, None), (3, "a b c d e", "x", "y"), (5, None, None, None)]
    got = sorted(map(tuple, jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, None), (3, 2, None), (5, 0, 5)], key=str)


def test_jaccard_id_with_a_set_named_elsewhere(spark):
    """Ids 5 and 9 have a second row, whose set a lesser id names, or which has no words."""
    a, b, c = ("a" + " ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (8, b + " end"), (9, ""), (9, c), (10, c + " end")]
    got = sorted(map(tuple, jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(3, 57, 3), (5, 57, 3), (5, 57, 5), (8, 58, 5), (9, 0, 9), (9, 57, 9), (10, 58, 9)])


def plain_row_components(rows, k, percent):
    """Components of rows, each for itself; named by the smallest doc_id, a null one below all."""
    parts = plain_components(list(enumerate(t for _, t in rows)), k, percent)
    members = {}
    for at, (_, c) in parts.items():
        members.setdefault(c, []).append(rows[at][0])
    low = {c: None if None in ids else min(ids) for c, ids in members.items()}
    return sorted(((rows[at][0], n, low[c]) for at, (n, c) in parts.items()), key=str)


@pytest.mark.parametrize("turns", [0, 2])
def test_jaccard_rows_that_share_a_doc_id(spark, monkeypatch, turns):
    """Rows with one doc_id and different texts, null ids among them; without proposals the scan alone finds all links."""
    monkeypatch.setattr(jaccard, "TURNS", turns)
    for name, value in (("BLOCK", 3), ("HELD", 20), ("CHECKED", 2)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(21)
    rows = []
    for i in range(30):
        ws = [f"v{r.randrange(10**6)}" for _ in range(r.choice([6, 15, 40, 90]))]
        other = [f"v{r.randrange(10**6)}" for _ in range(r.choice([5, 25, 60]))]
        near = [*ws[:-1], "x"] if len(ws) > 20 else ws
        rows += [(i % 12, " ".join(ws)), (i % 12, " ".join(other)), (100 + i, " ".join(near)), (None, " ".join([*other, "y"])), (None, " ".join([*near, "common phrase of five words"]))]
    rows += [(1, "a common phrase of five words"), (2, "b common phrase of five words"), (2, None), (2, "")]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_row_components(rows, 4, 85)


def test_jaccard_clashing_columns(spark, copies):
    d = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t, *_ in copies[:60]], "doc_id long, text string, rep string, n int, component_id int, digest int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(d).collect()}
    assert got == plain_components(copies[:60], 4, 85)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)] + [(5, 5), (None, 1)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(data):
    order = sorted(data, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t, *_ in order:
        ws = WORD.findall(t or "")
        gone = set()
        for p in range(len(ws) - 19):
            w = tuple(ws[p : p + 20])
            if w in seen:
                gone |= set(range(p, p + 20))
            seen.add(w)
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for n, w in enumerate(ws) if n not in gone).encode()).hexdigest())
    return out


def test_repeats_against_plain_search(spark, copies, monkeypatch):
    loop = [(1000, "la " * 70, "en", "s"), (1001, "x " + "la " * 25, "en", "s"), (1002, "é " * 19, "en", "s"), (1003, "é " * 19, "en", "s")]
    data = copies + loop
    for chunk, phrases, documents in ((1 << 21, 50_000, 4096), (400, 5, 3)):  # tiny ones: owners with several shards, shards with several parts
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        monkeypatch.setattr(repeats, "SHARD_PHRASES", phrases)
        monkeypatch.setattr(repeats, "SHARD_DOCS", documents)
        d = spark.createDataFrame([(*x, 1, 2) for x in data], SCHEMA + ", at int, shard int").repartition(5)
        got = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(d, digest=True).collect()}
        assert got == plain_repeats(data)


def test_only_automata_locate(spark, copies, monkeypatch):
    """Without the automata's answers nothing is removed: no place comes to a document any other way."""
    monkeypatch.setattr(repeats, "locate", lambda machine, letters, row: np.zeros(0, np.int64))
    found = list(repeats._windows(repeats.compile_automaton(np.zeros(0, np.uint64)), *(pa.array([x]) for x in (1, 2, "a b " * 20))))
    assert found == []


def test_automaton_against_plain_search():
    r = np.random.default_rng(3)
    letters, row = r.integers(0, 3, 4000).astype(np.uint8), np.sort(r.integers(0, 9, 4000))
    at, code = repeats.phrases(letters, row)
    chosen = np.unique(code)[::5]
    got = repeats.locate(repeats.compile_automaton(chosen), letters, row)
    assert sorted(got) == at[np.isin(code, chosen)].tolist() and len(got) > 50


def test_repeats_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(22))
    rows = [(None, passage, "a", "b"), (1, f"x {passage} y", None, None), (1, f"x {passage} y", None, None), (2, None, None, None)]
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 0, passage), (1, 22, "x y"), (1, 22, "x y"), (2, 0, "")], key=str)
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


PAGES = "page_id long, url string, html string, type string"


def test_warc_round_trip(spark):
    long = "<p>é条😀 " + "x" * 120
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    html = [(1, "http://a/ b", long), (2, "http://b", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u\r\nX: y", tricky), (8, "u", tricky), (8, "u", tricky), (9, "u", "\r\n\r\n" * 60), (10, "u", "y" * 2_000_000), (None, "u", "no id" * 40), (None, "u", long)]
    pages = spark.createDataFrame([(*x, "clash") for x in html], PAGES)
    got = warc.archive_and_read(pages).collect()
    assert len(got) == len(html)
    want = []
    for i, _, h in html:
        b = (h or "").encode()
        first = min((j for j, _, x in html if x == h and j is not None), default=None)
        revisit = len(b) >= 100 and first is not None and first != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_payloads_and_assembly(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "<b>é</b>", "t"), (2, "http://y/", "z" * 200, "t"), (3, "http://z/", "z" * 200, "t")], PAGES)
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.groupBy("type").count().orderBy("type").collect() == [("metadata", 3), ("request", 3), ("response", 2), ("revisit", 1)]
    c = {r["uri"]: r for r in warc.assemble(records).collect()}
    assert bytes(c["http://x/"]["response"]["payload"]).decode() == "<b>é</b>" and c["http://x/"]["request"]["fields"].startswith("GET http://x/")
    assert c["http://z/"]["response"]["refers_to"] == c["http://y/"]["response"]["record_id"]
    lone = warc.assemble(records.where(F.col("type") != "request"))
    assert lone.where("request IS NOT NULL").count() == 0 and lone.count() == 3
    assert list(warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")) == [] and list(warc.parse(b"")) == []


def test_pipeline_stages(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    say = {"en": "the and of to house with there which were from".split(), "de": "der und die haus nicht mit schön welche waren aus".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(r.choice(say[lang]) + r.choice(["", "", "x", "yz"]) for _ in range(60)), lang, ("a", "a", "b", None)[i % 4], 0))
    leak = " ".join(f"q{i}" for i in range(15))
    rows += [(200, rows[0][1], "en", "a", 0), (201, rows[2][1] + " end", "en", "a", 0), (202, rows[4][1] + " " + leak, "en", "a", 0), (203, None, "en", "a", 0), (204, "1234", "en", "a", 0), (205, rows[6][1][:200] + ' token = "abcdef0123456789abcdef0123456789" ' + rows[8][1], "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({x["doc_id"] for x in docs.collect()})
    assert seen[0] == set(range(120)) | {200, 201, 202, 205}
    assert seen[1] == seen[0] - {200, 201} and seen[2] == seen[1] - {202} and seen[3] == seen[2]
    assert "[SECRET]" in docs.where("doc_id = 205").first()["text"]
    final = cp.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in final} == seen[3] and all(0 <= x["taken"] <= 3 * x["size"] for x in final)


def test_pipeline_near_duplicates_row_by_row(spark):
    cp = pytest.importorskip("corpus_pipeline")
    r = random.Random(11)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    rows = [(None, text[i]) for i in range(5)] + [(None, text[0]), (None, text[1] + " end")]  # five texts, a repeat, a near copy
    rows += [(1, text[5]), (2, text[5] + " end"), (2, text[6]), (2, text[7]), (2, text[7])]  # a near copy and two own texts share an id
    rows += [(3, text[8]), (4, text[8] + " end"), (5, None), (5, ""), (6, text[9]), (6, text[9]), (7, None), (None, None), (42, text[10])]
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x["doc_id"], x["text"]) for x in cp.near_duplicates(spark, d, "").collect()]
    one = {t for i, t in got if i is None and t and t.removesuffix(" end") == text[1]}
    want = [(None, text[i]) for i in (0, 2, 3, 4)] + [(1, text[5]), (2, text[6]), (2, text[7]), (3, text[8]), (5, None), (5, ""), (6, text[9]), (7, None), (None, None), (42, text[10])]
    assert len(one) == 1 and len(got) == len(want) + 1 and set(got) == {*want, *((None, t) for t in one)}
    plain = cp.near_duplicates(spark, d.where("doc_id IN (1, 3, 4, 6)"), "").collect()
    assert sorted((x["doc_id"], x["text"]) for x in plain) == [(1, text[5]), (3, text[8]), (6, text[9])]


def _shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_outside_all_pairs_are_not_moved(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(60))) for i in range(3000)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(20)]
    texts = materialize(spark.createDataFrame(rows, "rep long, text string").repartition(2), "test-texts")
    pairs = materialize(spark.createDataFrame([(i, 5000 + i) for i in range(20)] + [(7, 8)], "a long, b long"), "test-pairs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = _shuffled(spark)
        found = {tuple(r) for r in jaccard._verify(pairs, texts, 4, 85).collect()}
        moved = _shuffled(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {(i, 5000 + i) for i in range(20)}
    assert 0 < moved < 0.1 * sum(len(t) for _, t in rows)


def test_narrowed_keeps_all_keys_and_few_others(spark):
    table = spark.range(20000).select("id", F.concat(F.lit("k"), "id").alias("s"))
    for on in (["id"], ["id", "s"]):
        keys = materialize(table.where("id % 40 = 3").select(*on), "test-keys")
        inside, outside = parted(table, keys, on)
        got = {r[0] for r in inside.collect()}
        assert got >= set(range(3, 20000, 40)) and len(got) < 1500
        assert {r[0] for r in outside.collect()} == set(range(20000)) - got
        assert {r[0] for r in narrowed(table, keys, on).collect()} == got
    none = materialize(table.where("id < 0").select("id"), "test-none")
    assert narrowed(table, none, ["id"]).isEmpty()


def _held_by_workers(spark):
    """MB that the largest of Spark's Python workers holds between tasks."""

    def run(batches):
        import time
        from pathlib import Path

        for b in batches:
            time.sleep(0.3)  # so that each worker gets a task
            held = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
            yield pa.RecordBatch.from_arrays([pa.array([int(x) / 1024 for x in held])], names=["mb"])

    return spark.range(0, 4, 1, 4).mapInArrow(run, "mb double").agg(F.max("mb")).first()[0]


def test_workers_give_back_memory(spark):
    rng = random.Random(9)
    few = spark.createDataFrame([(i, "token = abc") for i in range(8)], "doc_id long, text string").repartition(4)
    words = [f"{rng.getrandbits(44):x}" for _ in range(60_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(240))) for i in range(4000)]
    many = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "test-texts")
    redacted = lambda d: secrets.redact(d).agg(F.sum(F.length("text"))).first()
    redacted(few)
    before = _held_by_workers(spark)
    redacted(many)
    assert _held_by_workers(spark) - before < 60


def test_mix_starts_no_python_on_executors(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "c", None)], "doc_id long, text string, source string")
    plan = mixing.mix(materialize(d, "test-mix"))
    assert plan.count() == 2 and "ExistingRDD" not in plan._jdf.queryExecution().toString()
