"""The operators against brute force on the smallest tables, and over odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, language, mixing, neighbours, pii, quality, repeats, urls, warc
from quillon.llm.common import held_out, text_batches
from quillon.llm.graphs import components
from quillon.llm.queries import QUERIES, SQL
from tests.llm.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# op1


def test_quality_learns(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, train=~held_out("doc_id"))
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.9
    assert got["score"].between(0, 1).all()


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    none = quality.fit(empty, labels.limit(0))
    assert quality.score(empty, none).count() == 0
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


# op2


def linked(rows):
    """Smallest id reachable by links, by all pairs."""
    sets = {}
    for k, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    at = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            at[x].append(k)
    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = top(j), top(k)
                up[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), top(k)) for k in sets}


def test_jaccard(documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents).collect()}
    assert got == linked(texts(documents))


def test_jaccard_hot_family(spark):
    """A family of near copies of which many share all but their own words, and a bridge between two halves."""
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in random.choice(120, int(random.integers(1, 5)), replace=False):
            words[j] = f"own{i}x{j}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(i, " ".join(base[:60]) + f" tail{i % 7} " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == linked(dict(rows))


def test_tree_loses_no_pair():
    random = np.random.default_rng(1)
    sets = [np.unique(random.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in random.integers(1, 400, 200)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 8], random.integers(0, 1 << 62, len(s) // 9).astype(np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    tree = jaccard.Tree(jaccard.Points([jaccard.point(s) for s in sets], n), n)
    for q, s in enumerate(sets):
        common = np.array([len(np.intersect1d(s, t)) for t in sets[:q]])
        want = [p for p in range(q) if 100 * common[p] >= 80 * (n[q] + n[p] - common[p])]
        assert set(want) <= set(tree.reach(q, 80).tolist())


def test_jaccard_odd(odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()]
    assert Counter(got)[(1, 8, 1)] == 2 and (2, 9, 1) in got
    assert (3, 0, 3) in got and (4, 0, 4) in got and (None, 1, None) in got and (7, 1, 7) in got
    assert jaccard.join(empty).count() == 0


def test_jaccard_null_id_in_a_group(spark):
    """A copy without an id leaves its group together, under the least id there is."""
    same, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(9, same), (None, same), (5, same), (None, same + " tail"), (None, other), (None, other), (-(1 << 63), "a lone text of its own")]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(9, 5): 1, (5, 5): 1, (None, 5): 2, (None, None): 2, (-(1 << 63), -(1 << 63)): 1}


def test_jaccard_trees_keep_partners_only(spark):
    """Unlike texts with a passage in common, and copies, leave no tree; near copies do."""
    random = np.random.default_rng(7)
    some = [[f"w{j}" for j in random.integers(0, 1 << 30, 60)] for _ in range(4)]
    passage = ["one", "passage", "that", "all", "share"]
    rows = [(i, " ".join(w + passage)) for i, w in enumerate(some)] + [(10 + i, " ".join(some[0] + passage)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    assert jaccard.Join(df, "doc_id", "text", 5, 80).forest().count() == 0
    near = df.union(spark.createDataFrame([(99, " ".join(["other"] + some[1][1:] + passage))], df.schema))
    forest = jaccard.Join(near, "doc_id", "text", 5, 80).forest()
    assert forest.select("node").distinct().count() == 2
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(near).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 99: 1} | {10 + i: 0 for i in range(5)}


def test_partnered_loses_no_pair():
    """Sets that reach the threshold both stay in the tree of the first shingle they have in common."""
    random = np.random.default_rng(5)
    family = np.arange(1000, 1080)
    sets = [np.unique(np.concatenate([random.choice(family, int(k), replace=False), random.integers(0, 900, int(j))])) for k, j in zip(random.integers(60, 81, 80), random.integers(0, 12, 80), strict=True)]
    pairs = 0
    for q, s in enumerate(sets):
        for t in sets[:q]:
            both = np.intersect1d(s, t)
            if 100 * len(both) < 80 * (len(s) + len(t) - len(both)):
                continue
            at = np.array([np.searchsorted(x, both[0]) for x in (s, t)])
            assert jaccard.partnered(np.array([0, 2]), np.array([len(s), len(t)]), at, 80).all()
            pairs += 1
    assert 100 < pairs < 3000
    assert not jaccard.partnered(np.array([0, 2, 3]), np.array([100, 100, 50]), np.array([12, 0, 0]), 80).any()


def test_texts_reach_python_in_small_batches(spark):
    """Within the step no batch has more than 1,024 texts; afterwards the session is as before."""
    df = spark.range(0, 5000, 1, 1).selectExpr("cast(id as string) as text")
    most = lambda: max(r["n"] for r in df.mapInArrow(lambda x: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in x), "n long").collect())
    before = most()
    with text_batches(spark):
        assert most() <= 1024
    assert most() == before


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


# op3


def test_neighbours(spark):
    emb = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = emb.toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = neighbours.search(emb, lambda i: i % 20 == 0).toPandas()
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and ids[q] not in own["vec_id"].tolist()
        at = {v: k for k, v in enumerate(ids)}
        assert np.allclose(own["score"], [s[at[v]] for v in own["vec_id"]])
        assert own[["score", "vec_id"]].apply(lambda r: (-r["score"], r["vec_id"]), axis=1).is_monotonic_increasing
        found += len(set(own["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert found / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_neighbours_of_queries_unlike_the_rest(spark):
    """Queries that point away from all other vectors: lists must be chosen by what queries need."""
    random = np.random.default_rng(1)
    n, centres = 4000, random.normal(size=(100, 64)) * 3
    ids = np.arange(n)
    x = np.where((ids % 20 == 0)[:, None], -centres[random.integers(0, 100, n)], centres[random.integers(0, 100, n)] + random.normal(size=(n, 64)))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    own = defaultdict(set)
    for r in neighbours.search(df, lambda i: i % 20 == 0).collect():
        own[r["query_id"]].add(r["vec_id"])
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, n, 20)] = -np.inf
    found = sum(len(own[20 * i] & set(np.argsort(-s)[:20].tolist())) for i, s in enumerate(score))
    assert found / (20 * len(score)) >= 0.9


def test_neighbours_odd(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [None, 1.0]), (120, [1.0, 2.0, 3.0]), (140, [3.0, -0.0]), (140, [3.0, -0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, lambda i: i % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    own = defaultdict(list)
    for r in got:
        own[r["query_id"]].append(r["vec_id"])
    assert own == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 140: [0, 1, 2, 3, 4]}
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0, k=5)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert neighbours.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


# op4


def hits(text, items, width=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    hit, found = set(), set()
    for i, t in items.items():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(width, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[a : a + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def test_decontaminate(spark, documents):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    short = {k: t for k, t in texts(documents).items() if len(t) < 3000}
    for part_words in (1_000_000, 300):
        got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.find(documents.where(F.length("text") < 3000), bench, part_words=part_words).collect()}
        assert got == {k: hits(t, items) for k, t in short.items()}
    clean = decontaminate.clean(documents, bench)
    assert clean.columns == documents.columns
    assert not decontaminate.find(clean, bench).where("contaminated").count()


def test_decontaminate_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Two, THREE four"), (1, "two three four"), (2, None), (3, "..."), (10, "three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.find(odd, bench).collect()}
    items = {1: "two three four", 10: bench.collect()[4]["text"]}
    assert got[1] == hits("one two three four five six seven eight nine ten eleven twelve", items)
    assert got[2] == (13, 12, 2, sha("1,10"), True)
    assert got[3] == got[4] == (0, 0, 0, sha(""), False)
    assert decontaminate.find(empty, bench).count() == 0
    assert not decontaminate.find(odd, bench.limit(0)).where("contaminated").count()
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_decontaminate_parts_change_nothing(spark):
    """Overlapping items in different parts, rows without an id and rows that repeat one."""
    long = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(long[i : i + 14])) for i in range(0, 28, 2)], "item_id long, text string")
    own = lambda n: " ".join(f"own{i}" for i in range(n))
    passage = " ".join(long)
    rows = [(1, f"{own(60)} {passage} end"), (1, f"{passage} {own(10)}"), (None, f"{own(45)}, {passage}"), (None, own(5)), (None, None), (2, f"{' '.join(long[:14])} {own(20)} {' '.join(long[26:])} {own(9)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = Counter((k, *hits(t or "", items)) for k, t in rows)
    for part_words in (1_000_000, 30):
        assert Counter(tuple(r)[:6] for r in decontaminate.find(df, bench, part_words=part_words).collect()) == want
        got = Counter(map(tuple, decontaminate.clean(df, bench, part_words=part_words).collect()))
        assert got == Counter([(1, f"{own(60)}  end"), (None, f"{own(45)}, "), (None, own(5)), (None, None), (2, f" {own(20)}  {own(9)}")])
    assert len(decontaminate.parts(bench, "item_id", "text", 30)) > 2


# op5


def test_mixing_meets_targets(documents):
    got = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (per["taken"] - per["target"]).abs().max() <= 1
    assert per["target"].sum() == pytest.approx(got["size"].sum())
    copies = mixing.schedule(mixing.mix(documents)).toPandas()
    assert copies["words"].sum() == got["taken"].sum()
    assert copies["position"].between(0, 1).all() and copies["position"].is_monotonic_increasing


def test_mixing_odd(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert {r["taken"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))


# op6


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language.fit(docs, train=~held_out("id"))
    got = language.predict(docs, profiles, keep=("doc_id", "lang")).where(held_out("doc_id")).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.95


def test_language_odd(odd, empty):
    profiles = language.fit(odd)
    got = {r["doc_id"]: r for r in language.predict(odd, profiles, keep=("doc_id", "score"), as_score="cosine").collect()}
    assert got[6]["lang_pred"] == "fr" and got[1]["lang_pred"] == "en"
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4
    assert all(0 <= r["cosine"] <= 1 for r in got.values())
    assert language.predict(empty, language.fit(empty), keep=("doc_id",)).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, {}, keep=("doc_id",)).collect()} == {"und"}


def test_bundles_are_what_they_say():
    """A document's vector is the sum over n-grams of the product of rotated letter vectors, however it is cut."""
    v, lettered = language.bundles(["ab c"], 256)
    letters = {c: language.letter_vectors(np.array([ord(c)], np.uint32), 256)[0].astype(float) for c in "abc "}
    want = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in (" ab", "ab ", " c "))
    assert np.array_equal(v[0], want) and lettered[0]
    text = ["der die das und nicht " * 50]
    assert np.array_equal(language.bundles(text, 128)[0], language.bundles(text, 128, run=90)[0])


# op7


def removed(rows, length=100):
    seen, out = set(), {}
    for k in sorted(rows):
        b = rows[k].encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(s)
        out[k] = len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), sha(bytes(c for c, m in zip(b, mark, strict=True) if not m))
    return out


def test_repeats(documents):
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.deduplicate(documents).collect()}
    assert got == removed(texts(documents))


def test_repeats_low_entropy_and_edges(spark):
    random = np.random.default_rng(2)
    word = lambda n: "".join(random.choice(list("abcdefgh "), n))
    passage = word(150)
    rows = {1: "a" * 500, 2: "a" * 99, 3: "ab" * 200 + "a" * 150, 4: word(40) + passage + word(60), 5: passage[:120] + word(30), 6: word(10) + passage[40:141], 7: passage[51:], 8: "é" * 80, 9: "x" + "é" * 80, 10: "", 11: word(300) * 2}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: tuple(r)[1:5] for r in repeats.deduplicate(df).collect()} == removed(rows)


def test_repeats_odd(odd, empty):
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.deduplicate(odd).collect()}
    assert got[3] == (0, 0, 0, sha("")) and got[1][1] == 0
    assert got[7] == removed({7: "x" * 300_000})[7]
    assert repeats.deduplicate(empty).count() == 0


def test_repeats_rows_of_one_id(spark):
    """Rows without an id, and rows that repeat one, lose only what stands in an earlier row."""
    random = np.random.default_rng(4)
    word = lambda n: "".join(random.choice(list("abcdefgh "), n))
    passage, late = word(150), word(120)
    rows = [(None, passage + word(200)), (None, passage + word(90)), (None, word(400)), (None, word(30)), (3, late + word(50)), (3, word(300)), (3, word(70) + late), (4, late), (4, late)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = df.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()
    want = removed({i: r["text"] for i, r in enumerate(ordered)})
    got = Counter(tuple(r)[:5] for r in repeats.deduplicate(df).collect())
    assert got == Counter((r["doc_id"], *want[i]) for i, r in enumerate(ordered))


def test_repeats_frequent_and_large(spark, monkeypatch):
    """Ranks that are frequent, and ranks with more parts than a task compares, lose nothing."""
    random = np.random.default_rng(6)
    word = lambda n: "".join(random.choice(list("abcdefgh "), n))
    line, passage = word(76), word(230)
    rows = {i: word(int(n)) + (line if i % 2 else passage[i % 50 :]) + word(60) + line[: i % 40] for i, n in enumerate(random.integers(0, 200, 120))}
    rows |= {200: "ab" * 300, 201: word(90) + "ab" * 90, 202: rows[7] + rows[8], 203: rows[9]}
    want = removed(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    for names in ({"GROUP": 1}, {"SAMPLE": 1, "HOT": 1}, {"SAMPLE": 1, "HOT": 4, "GROUP": 2}):
        with monkeypatch.context() as m:
            for name, value in names.items():
                m.setattr(repeats, name, value)
            assert {r["doc_id"]: tuple(r)[1:5] for r in repeats.deduplicate(df).collect()} == want


def shuffled(spark):
    """Bytes that this session's stages have written to shuffles, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_repeats_shuffles_in_proportion(spark, monkeypatch):
    """No filter of a fixed size decides what is sorted: one that a large corpus has filled lets every window through."""
    monkeypatch.setattr(repeats, "BITS", 6, raising=False)
    random = np.random.default_rng(8)
    word = lambda n: "".join(random.choice(list("abcdefghijklmnop "), n))
    passages = [word(200) for _ in range(100)]
    rows = [(i, word(1700) + passages[i % 100] + word(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled(spark)
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.deduplicate(df).collect()}
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert got == removed(dict(rows))
    assert written < 6 * sum(len(x) for _, x in rows)


# op8


def test_warc_round_trip(spark, tmp_path):
    records = warc.from_pages(spark.read.parquet(f"{SMALL}/pages.parquet")).drop("page_id")
    every = records.unionByName(warc.derive(records))
    for compress in (True, False):
        warc.write(every, f"{tmp_path}/{compress}", compress=compress)
        back = warc.read(spark, f"{tmp_path}/{compress}/part-*")
        key = lambda df: sorted((str(r["record_id"]), bytes(r["block"]), str(r.asDict())) for r in df.collect())
        assert key(back) == key(every)


def test_warc_links(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title> A  b</title></head><body><p>x &amp; y</p><script>no()</script><a href='/'>l</a></body></html>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    records = warc.from_pages(pages)
    made = warc.derive(records, keep=("page_id",)).collect()
    own = {r["page_id"]: r["record_id"] for r in records.collect()}
    assert len(made) == 6 and all(r["refers_to"] == own[r["page_id"]] for r in made)
    text = next(r["block"] for r in made if r["page_id"] == 1 and r["warc_type"] == "conversion").decode()
    assert text == "A b\nx & y\nl"
    meta = next(r["block"] for r in made if r["page_id"] == 1 and r["warc_type"] == "metadata").decode()
    assert "title: A b\r\n" in meta and "outlinks: 1\r\n" in meta and "status: 200\r\n" in meta
    assert all(r["block_digest"] == "sha256:" + sha(bytes(r["block"])) for r in made)
    assert warc.derive(warc.from_pages(pages.limit(0))).count() == 0


def test_warc_bytes(spark):
    head = lambda kind: b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n"
    blocks = {
        "latin": head(b"text/html; charset=ISO-8859-1") + "<p>café</p>".encode("latin-1"),
        "utf": head(b"text/html; charset=utf-8") + "<p>café</p>".encode(),
        "broken": head(b"text/html") + b"<p>caf\xe9 now</p>",
        "image": head(b"image/png") + bytes(range(256)),
        "name": b"HTTP/1.1 200 OK\r\nX-Name: \xe9\xe9\r\n\r\n<p>x</p>",
        "bare": b"<p>no head</p>",
        "empty": b"",
        "none": None,
        "long": head(b"text/html") + b"<p>word </p>" * 200_000,
    }
    schema = "page_id string, extra int, " + warc.RECORD
    row = lambda k, b: (k, 1, "response", f"<{k}>", "u", warc.DATE, None, None, None, None, [], b)
    records = spark.createDataFrame([row(k, b) for k, b in blocks.items()], schema)
    made = warc.derive(records, keep=("page_id",)).collect()
    text = {r["page_id"]: bytes(r["block"]).decode() for r in made if r["warc_type"] == "conversion"}
    assert text == {"latin": "café", "utf": "café", "broken": "caf\ufffd now", "image": "", "name": "x", "bare": "no head", "empty": "", "none": "", "long": "\n".join(["word"] * 200_000)}
    meta = {r["page_id"]: bytes(r["block"]).decode() for r in made if r["warc_type"] == "metadata"}
    assert "sourceContentType: image/png\r\nsourceLength: 300\r\n" in meta["image"] and "sourceLength: 0\r\n" in meta["none"]


# op9


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


HARD = ["a@b.c%d@e.f g@h", "x@y..z u@v.w.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004", "é +1 (743) 555-3824 +12 34", "4111-1111 1111 1111 4111111111111112", "@@ a@@b.c @x.y ..@a.b", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "++1234567890 +1.(2)-3456789012", "\U0001f600 me@x.org \U0001f600 1.1.1.1"]


def test_pii_base(spark, documents):
    rows = texts(documents) | {-i - 1: t for i, t in enumerate(HARD)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.find(df)).collect()}
    assert got == {k: sha(base(t)) for k, t in rows.items()}


def test_pii_discovers(spark):
    """Identifiers in contexts that seeds have shown, in a form no base pattern knows."""
    seeds = [(i, f"please call +1 (743) 555-{1000 + i} today ok") for i in range(6)]
    df = spark.createDataFrame([*seeds, (50, "please call 743/5551234 today ok"), (51, "number 743/5551234 here")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df, confident=0.5)).collect()}
    assert got[50] == "phone:12:23" and got[51] == ""
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[0] == "please call [PHONE] today ok" and out[51] == "number 743/5551234 here"


def test_pii_odd(odd, empty):
    got = {r["doc_id"]: r for r in pii.digest(pii.find(odd)).collect()}
    assert [got[9][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert got[3]["spans"] == got[4]["spans"] == ""
    assert pii.digest(pii.find(empty)).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()


def test_pii_rows_of_one_id(spark):
    """Rows without an id, and rows that repeat one, are found and redacted each by its own text."""
    rows = [(None, "write to me@host.example.com"), (None, "some clean words that nothing may overwrite"), (None, "far behind these words 10.0.0.255 stands"), (7, "mail you@host.example.org"), (7, "a card 4111 1111 1111 1111 here"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in pii.redact(df).collect())
    assert got == Counter([(None, "write to [EMAIL]"), (None, rows[1][1]), (None, "far behind these words [IP] stands"), (7, "mail [EMAIL]"), (7, "a card [CARD] here"), (7, None)])
    seeds = [(None, f"please call +1 (743) 555-{1000 + i} today ok") for i in range(6)]
    more = [(None, "please call 743/5551234 today ok"), (None, "number 743/5551234 here")]
    found = Counter(r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(seeds + more, "doc_id long, text string"), confident=0.5)).collect())
    assert found == {"phone:12:29": 6, "phone:12:23": 1, "": 1}


# op10


def test_urls(spark):
    pages = [(i, f"https://blog.site{i}.example.net/en/{i}") for i in range(40)] + [(100 + i, f"http://w{i}.spam.net/buy?{i}") for i in range(40)]
    pages += [(200, None), (201, "no scheme"), (202, "HTTP://X.Example.COM/de/1?q#f"), (203, "http://example.org/fr/"), (204, "http://fooorg/fr/"), (205, "http://net"), (206, "http://a.net?x/"), (207, "")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[0]["rule"] == "example.net/en/" and got[0]["verdict"] == "allow" and got[100]["rule"] == "net/"
    assert (got[202]["host"], got[202]["path"], got[202]["rule"]) == ("x.example.com", "/de/1", "example.com/de/")
    assert got[203]["rule"] == "org/fr/" and got[204]["rule"] is None and got[205]["rule"] is None and got[206]["rule"] is None
    assert (got[200]["host"], got[200]["path"], got[200]["rule"]) == ("", "", None) and got[201]["host"] == ""
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def witten_bell(texts, order=urls.ORDER):
    """The probability of a byte after a context, from plain counts of ``texts``."""
    seen = Counter((b[i - o : i], b[i]) for b in texts for i in range(len(b)) for o in range(order + 1) if i >= o)
    total, kinds = Counter(), Counter()
    for (context, _), n in seen.items():
        total[context] += n
        kinds[context] += 1

    def p(context, byte):
        less = p(context[1:], byte) if context else 1 / 256
        n = total[context] + kinds[context]
        return (seen[context, byte] + kinds[context] * less) / n if n else less

    return p


def test_url_ratio_by_hand(spark):
    """Ratios equal a plain count of every context; each model is a distribution."""
    good = [f"http://a{i}.org/fr/page{i % 3}" for i in range(12)] + ["http://x.org/fr/\u00e9"] * 2
    bad = [f"http://b{i}.net/buy?{i * i}" for i in range(12)]
    other = ["", "h", "http://a1.com/fr/page2", "\x00\x00\x00", "ftp://\u20ac" + "z" * 400_000, *good[:2], *bad[:2]]
    labelled = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad], "url string, accept int").repartition(3)
    rows = spark.createDataFrame(list(enumerate(other)), "row long, url string").repartition(3)
    got = {r["row"]: r["ratio"] for r in urls.scored(rows, urls.fit(labelled)).collect()}
    yes, no = (witten_bell([u.encode() for u in us]) for us in (good, bad))
    for k, u in enumerate(other):
        b = u.encode()
        if len(b) > 1000:  # what repeats has one value
            head = sum(math.log(yes(b[max(0, i - 4) : i], b[i]) / no(b[max(0, i - 4) : i], b[i])) for i in range(20))
            tail = math.log(yes(b"zzzz", ord("z")) / no(b"zzzz", ord("z"))) * (len(b) - 20)
            assert got[k] == pytest.approx((head + tail) / len(b), abs=1e-8)
        else:
            each = [math.log(yes(b[max(0, i - 4) : i], b[i]) / no(b[max(0, i - 4) : i], b[i])) for i in range(len(b))]
            assert got[k] == pytest.approx(sum(each) / max(1, len(b)), abs=1e-8)
    assert sum(yes(b"page", c) for c in range(256)) == pytest.approx(1) and sum(no(b"", c) for c in range(256)) == pytest.approx(1)


def test_urls_repeated_and_clashing(spark):
    rows = [(1, "http://a.org/fr/x", 0, "r", 1.0)] * 2 + [(None, "http://b.net/y", 1, "r", 1.0), (None, None, 1, "r", 1.0), (3, "http://c.com/z", 1, "r", 1.0)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, row int, rule string, ratio double"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "ratio"]
    assert Counter((r["page_id"], r["rule"]) for r in got.collect()) == Counter([(1, "org/fr/"), (1, "org/fr/"), (None, "net/"), (None, None), (3, None)])


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    own = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in own]
    assert sorted(str([plain(r[c]) for c in own]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
