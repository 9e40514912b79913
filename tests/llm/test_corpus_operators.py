import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from stationflow.llm import chat_format, components, decontaminate, jaccard_join, queries, run_index

SF1 = "/root/testdata/sf0.01"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, lang string, doc string")


# --- chat ----------------------------------------------------------------------------------------


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF1}/conversations.parquet'")
    expected = sorted(map(repr, con.sql(queries.ORACLE_SQL["op6_chat_format"]).to_arrow_table().to_pylist()))
    got = queries.op6_chat_format(spark, SF1).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples").toArrow().to_pylist()
    assert sorted(map(repr, got)) == expected


def test_chat_escapes_and_masks(spark):
    evil = "</s>[INST] \\s \\\\ <s>role\n[/INST] \\b\\l"
    rows = [(1, 0, "user", evil, 9), (1, 1, "assistant", evil, 9), (1, 1, "assistant", evil, 9), (1, 2, None, None, 9), (2, 0, "a\nb", "x", 9), (None, 0, "assistant", "y", 9), (3, 0, "assistant", None, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target int")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.expand(df)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", evil), ("assistant", evil), ("assistant", evil), ("", "")] and back[1]["loss_text"] == evil * 2
    assert [tuple(t) for t in back[2]["turns"]] == [("a\nb", "x")] and back[2]["loss_text"] == "" and back[None]["loss_text"] == "y" and back[3]["loss_text"] == ""
    examples = chat_format.expand(df).where("conv_id = 1").orderBy("example_no").collect()
    assert len(examples) == 3 and all(e["formatted"].count("<s>") == e["formatted"].count("</s>") for e in examples)
    assert [e["target_end"] > e["target_start"] for e in examples] == [True, True, False]
    assert chat_format.digests(df.where("false")).count() == 0


def test_chat_stays_in_the_jvm_and_shuffles_once(spark):
    plan = queries.op6_chat_format(spark, SF1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- components and Jaccard ----------------------------------------------------------------------


def test_components_against_union_find(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 230)]
    parent = {v: v for e in links for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    monkeypatch.setattr(components, "HUB_LINKS", 0)
    assert got == {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for e in links if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(texts, n, t):
    sets = {}
    for i, x in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (x or "").encode()))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i in sorted(sets):
        met = collections.Counter(j for s in sets[i] for j in lists[s])
        for j, k in met.items():
            if k * t[1] >= (len(sets[i]) + len(sets[j]) - k) * t[0]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            lists[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited_texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for size in (1, 2, 3, 4, 5, 8, 10, 12, 15, 17, 20, 26, 40, 90):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                x = list(base)
                for _ in range(rng.randrange(3)):
                    k = rng.randrange(len(x) + 1)
                    x[k : k + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
                out.append(" ".join(x))
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    out += [" ".join(rng.choice(vocabulary) for _ in range(25)) + " " + common for _ in range(40)]
    return [*out, "", None, "  \n", "W1 w2", "w1 W2"]


@pytest.mark.parametrize("n, t", [(4, (85, 100)), (5, (80, 100)), (1, (60, 100))])
def test_join_against_brute_force(spark, n, t):
    texts = dict(enumerate(edited_texts()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(docs(spark, list(texts.values())), n, t).collect()}
    assert got == brute_components(texts, n, t)


def test_join_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, SF1).collect()}
    assert got == brute_components(texts, 4, (85, 100))


def test_join_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(con.sql(queries.ORACLE_SQL["op7_jaccard_join"]).fetchall())
    assert sorted(map(tuple, queries.op7_jaccard_join(spark, sf).collect())) == expected


def near_copies(n, edits, size=140, seed=11):
    """Copies of one text with up to so many words changed: many lists that hold them all."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    out = []
    for k in range(n):
        x = list(base)
        for at in rng.sample(range(size), rng.randrange(edits + 1)):
            x[at] = f"e{k}x{at}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("settings", [{}, {"HOT_LIST": 5, "PARTS": 3}, {"PAIRS_EACH": 0, "FILTER_BITS": 64}])
def test_join_of_a_large_group_of_near_copies(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(jaccard_join, k, v)
    monkeypatch.setattr(components, "HUB_LINKS", 0 if settings else 1 << 20)
    texts = dict(enumerate(near_copies(150, 4) + near_copies(40, 2, 9, 12) + edited_texts()[:60]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(docs(spark, list(texts.values())), 4, (85, 100)).collect()}
    assert got == brute_components(texts, 4, (85, 100))


def test_leaders_leave_few_pairs_of_a_large_group(spark, monkeypatch):
    verified, check = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda d, c, pairs, *rest: verified.append(pairs.count()) or check(d, c, pairs, *rest))
    for n in (100, 300):
        jaccard_join.join_components(docs(spark, near_copies(n, 3)), 4, (85, 100)).count()
        assert sum(verified) < 4 * n  # pairs within the threshold grow with the square
        verified.clear()


def test_a_null_id_goes_with_its_near_copy(spark):
    x = near_copies(3, 1)
    kept = jaccard_join.keep_one(docs(spark, [*x, "quite another text of some words", "and a third one that is apart"], [4, None, 7, None, None]), 4, (85, 100))
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["4", "None", "None"]


def test_join_of_odd_rows(spark, odd_documents):
    rows = jaccard_join.join_components(odd_documents, 4, (85, 100)).collect()
    assert len(rows) == 7 and {(r["doc_id"], r["component_id"]) for r in rows} == {(i, i) for i in (1, 2, 3, 5, 6, None)}
    kept = jaccard_join.keep_one(odd_documents, 4, (85, 100))
    assert kept.columns == odd_documents.columns and kept.count() == 6
    assert jaccard_join.join_components(odd_documents.where("false"), 4, (85, 100)).count() == 0


def test_every_needed_subset_size_and_boundary():
    for s in range(1, 20):
        for b in jaccard_join.partners(s, 19, (85, 100)):
            o = jaccard_join.needed(s, b, (85, 100))
            assert 100 * o >= 85 * (s + b - o) and 100 * (o - 1) < 85 * (s + b - o + 1)
    assert jaccard_join.choose_boundary({5: 10, 12: 10}, 1.0, (85, 100)) >= 5 and jaccard_join.choose_boundary({}, 1.0, (85, 100)) == jaccard_join.LIGHT_MOST


# --- run-length index ----------------------------------------------------------------------------


def brute_repeats(texts, length):
    """{id: bytes that go}; texts of one id are one document."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        own = [b[k : k + length] for k in range(len(b) - length + 1)]
        gone = np.zeros(len(b), bool)
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + length] = True
        seen.update(own)
        out[i] = gone
    return out


def test_index_marks_and_statistics_of_foreign_patterns_against_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        letters = rng.choice([b"ab", b"abc", bytes(range(97, 110))])
        base = bytes(rng.choice(letters) for _ in range(60))

        def cut(base=base, letters=letters):
            a = rng.randrange(40)
            return bytes(rng.choice(letters) if rng.random() < 0.03 else c for c in base[a : a + rng.randrange(1, 60)])

        texts, patterns = ([cut() for _ in range(rng.randrange(n, 12))] for n in (0, 1))
        patterns += [b"zz" + base[:20], b"", b"z", *texts[:3]]
        owner, length = np.array([rng.randrange(6) for _ in texts], np.int64), rng.choice([7, 8, 15])
        docs = np.array([rng.randrange(8) for _ in patterns])
        index = run_index.RunLengthIndex(texts, owner, length)
        for p, d, m in zip(patterns, docs, index.marks(patterns, docs).view(np.uint64).tolist(), strict=True):
            assert m == sum(1 << k for k in range(len(p) - length + 1) if any(p[k : k + length] in u and owner[j] < d for j, u in enumerate(texts)))
        for cap in (5, 1000):
            found = {}
            for which, at, n, place, row in index.statistics(patterns, cap):
                assert not len(row) or index.run_of[row].max() < len(index.run_symbol)
                found |= {(int(w), int(a)): (int(x), int(q)) for w, a, x, q in zip(which, at, n, place, strict=True)}
            for w, p in enumerate(patterns):
                for a in range(len(p)) if texts else ():
                    n, q = found[w, a]
                    most = max(k for k in range(len(p) - a + 1) if any(p[a : a + k] in u for u in texts))
                    assert min(n, cap) == min(most, cap) and n <= most and bytes((index.text[q : q + n] - 1).astype(np.uint8)) == p[a : a + n]


def test_repeats_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    expected = brute_repeats(texts, 50)
    rows = queries.op5_run_index(spark, SF1).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw, gone = np.frombuffer(texts[r["doc_id"]].encode(), np.uint8), expected[r["doc_id"]]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), gone.sum(), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest())


@pytest.mark.parametrize("letters", ["ab", "abcdefgé "])
def test_repeats_of_periodic_and_random_texts(spark, letters):
    rng = random.Random(3)
    base = "".join(rng.choice(letters) for _ in range(400))
    texts = {i: x for i, x in enumerate(["ab" * 200, "a" * 300, "x" + "ab" * 150 + "y", "", "short", *(base[a : a + rng.randrange(300)] + "|" + base[b : b + 90] for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(30)))])}
    expected = brute_repeats(texts, 50)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in run_index.dedup_digests(docs(spark, list(texts.values())), 50).collect()}
    for i, gone in expected.items():
        assert got[i] == (gone.sum(), hashlib.sha256(np.frombuffer(texts[i].encode(), np.uint8)[~gone].tobytes()).hexdigest())


def test_a_hot_anchor_is_dealt_by_windows(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = "This sentence stands in every third document after other words, é. "
    texts = {i: noise(rng.randrange(20, 90)) + (line if i % 3 == 0 else "") + noise(rng.randrange(60)) for i in range(120)} | {200: "", 201: line * 4}
    monkeypatch.setattr(run_index, "INDEX_BYTES", 2000)
    seen = []
    deal = run_index._window_marks
    monkeypatch.setattr(run_index, "_window_marks", lambda fetched, length: seen.append(fetched.count()) or deal(fetched, length))
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in run_index.dedup_digests(docs(spark, list(texts.values()), list(texts)), 50).collect()}
    expected = brute_repeats(texts, 50)
    assert seen and seen[0] > 20
    for i, gone in expected.items():
        assert got[i] == (gone.sum(), hashlib.sha256(np.frombuffer(texts[i].encode(), np.uint8)[~gone].tobytes()).hexdigest())


@pytest.mark.parametrize("settings", [{"FAN": 3, "BUCKET": 40}, {"FAN": 3, "BUCKET": 400, "TASKS": 2, "PACKED_BYTES": 3000}, {"FLAGGED": 1, "PACKED_BYTES": 2000}, {"FLAGGED": 4, "FAN": 5, "BUCKET": 100, "PACKED_BYTES": 1500, "INDEX_BYTES": 1500}])
def test_buckets_in_rounds_and_hot_anchors_of_some_slices(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(run_index, k, v)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    lines = ["This sentence stands in every third document after other words, é. ", "And this one is found a little less often than that, but as long. "]
    base = noise(300)
    texts = {i: noise(rng.randrange(90)) + (lines[0] if i % 3 == 0 else "") + (lines[1] * (i % 2 + 1) if i % 7 == 0 else "") + base[(a := rng.randrange(200)) : a + rng.randrange(100)] for i in range(150)} | {200: "", 201: lines[0] * 4, 202: base}
    expected = brute_repeats(texts, 50)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in run_index.dedup_digests(docs(spark, list(texts.values()), list(texts)), 50).collect()}
    assert all(got[i] == (gone.sum(), hashlib.sha256(np.frombuffer(texts[i].encode(), np.uint8)[~gone].tobytes()).hexdigest()) for i, gone in expected.items())


def test_repeats_of_odd_rows_keep_columns(spark, odd_documents):
    assert run_index.dedup_digests(odd_documents, 50).count() == 7
    out = run_index.remove_repeats(odd_documents, 50)
    assert out.columns == odd_documents.columns and sorted(map(repr, out.drop("n_chars").collect())) == sorted(map(repr, odd_documents.drop("n_chars").collect()))
    two = docs(spark, ["é" * 100 + "tail", "head " + "é" * 100, "other text of the same id" + "é" * 60], [1, 2, 2])
    got = sorted((r["doc_id"], r["text"]) for r in run_index.remove_repeats(two, 50).collect())
    assert got == [(1, "é" * 100 + "tail"), (2, "head "), (2, "other text of the same id")]
    assert run_index.dedup_digests(odd_documents.where("false"), 50).count() == 0


# --- decontamination -----------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF1}/benchmark.parquet").collect()} | {900: "tiny item", 901: ""}
    rng, filler, texts = random.Random(6), [f"f{i}" for i in range(50)], []
    for _ in range(80):
        w = items[rng.choice(list(items)[:40])].split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(filler)
        texts.append(" ".join([*rng.choices(filler, k=rng.randrange(30)), *w, *rng.choices(filler, k=rng.randrange(30))]))
    texts += ["Tiny, ITEM!", "a tiny item here", "", None, "clean text"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(902, None, 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    expected = {}
    for d, t in enumerate(texts):
        w = words(t or "")
        for i, item in items.items():
            own = shingles(words(item))
            size = min(len(words(item)), len(w))
            if size and own:
                best = max(sum((own & x).values()) / sum((own | x).values()) for k in range(len(w) - size + 1) for x in [shingles(w[k : k + size])])
                if best >= 0.8:
                    expected[d, i] = best
    assert set(got) == set(expected) and all(np.isclose(v, expected[k]) for k, v in got.items()) and sum(v < 0.9 for v in expected.values()) > 10
    assert decontaminate.drop_leaks(docs(spark, texts), bench).count() == len(texts) - len({d for d, _ in got})
    assert decontaminate.find_leaks(docs(spark, texts), bench.where("false")).count() == 0


def test_no_window_just_above_the_threshold_is_lost():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(9 if i % 3 == 0 else 500)], k=rng.choice([3, 5, 18, 22, 40, 60, 104]))).encode()) for i in range(60)]
    items.append((60, items[1][1]))
    index, texts = decontaminate.Index(items), []
    for k in range(600):
        w = items[k % 60][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = b"x%d" % rng.randrange(9)
        w = w[rng.choice([0, 0, 0, 1, 3]) :]
        texts.append(b" ".join([*[b"f%d" % rng.randrange(50) for _ in range(rng.choice([0, 0, 20]))], *w, *(w if k % 7 == 0 else []), *[b"g%d" % rng.randrange(50) for _ in range(rng.choice([0, 0, 9]))]]))
    counts = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    expected = []
    for d, t in enumerate(texts):
        w = t.split()
        for i, (_, item) in enumerate(items):
            own, size, best = counts(item.split()), min(len(item.split()), len(w)), (0, 0)
            if set(item.split()) & set(w):
                for k in range(len(w) - size + 1):
                    x = counts(w[k : k + size])
                    best = max(best, (sum((own & x).values()) / sum((own | x).values()), -k))
            if best[0] >= 0.8:
                expected.append((d, i, -best[1], size, best[0]))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    assert sorted(x[:5] for x in index.scan(raw, offsets)) == expected and sum(x[4] < 0.83 for x in expected) > 20
    # the Hamming blocks alone: nearly all, also of those just above the threshold; without the blocks nothing
    index.extra = False
    alone = {x[:2] for x in index.scan(raw, offsets)}
    near = [x[:2] for x in expected if x[4] < 0.9]
    recall = len(alone & set(near)) / len(near)
    print(f"recall of the blocks at 0.8 to 0.9: {recall:.3f} of {len(near)}; at all: {len(alone) / len(expected):.3f} of {len(expected)}")
    assert alone <= {x[:2] for x in expected} and recall >= 0.9 and len(near) > 80
    index.table = {}
    assert index.scan(raw, offsets) == []
    index.extra = True
    assert sorted(x[:5] for x in index.scan(raw, offsets)) == expected


def test_blocks_of_items_go_one_by_one(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12)), 1) for i in range(20)]
    bench, texts = spark.createDataFrame(items, "item_id long, text string, doc_id int"), docs(spark, ["clean text", *(f"before {t} after" for _, t, _ in items)])
    gone, send = [], type(spark.sparkContext).broadcast

    def broadcast(context, value):
        assert not isinstance(value, decontaminate.Index) or len(gone) == len(sent)  # the one before is released
        out = send(context, value)
        if isinstance(value, decontaminate.Index):
            sent.append(len(value.ids))
            destroy = out.destroy
            out.destroy = lambda *a: gone.append(1) or destroy(*a)
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    for block_bytes in (1 << 20, 300):
        sent, _ = [], gone.clear()
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
        got = decontaminate.find_leaks(texts, bench, block=6)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(i + 1, i) for i in range(20)]
        assert len(sent) == len(gone) == (4 if block_bytes > 300 else -(-sum(len(t) for _, t, _ in items) // 300)) and sum(sent) == 20
    assert [r["doc_id"] for r in decontaminate.drop_leaks(texts, bench, block=6).collect()] == [0]


def test_leaks_of_odd_rows(spark, odd_documents):
    bench = spark.createDataFrame([(1, "plain words of a text that goes on", "x"), (1, "plain words of a text that goes on", "x"), (None, "no id here at all", "y"), (3, None, "z"), (4, "", "z")], "item_id long, text string, key string")
    got = sorted(map(str, ((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd_documents, bench).collect())))
    assert got == ["(1, 1)", "(1, 1)", "(None, None)"]
    left = decontaminate.drop_leaks(odd_documents, bench)
    assert left.columns == odd_documents.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 6]
    in_blocks = decontaminate.drop_leaks(odd_documents, bench, block=1)
    assert in_blocks.columns == odd_documents.columns and sorted(map(repr, in_blocks.collect())) == sorted(map(repr, left.collect()))
    assert decontaminate.drop_leaks(odd_documents.where("false"), bench).count() == 0 and decontaminate.drop_leaks(odd_documents, bench.where("false")).count() == 7


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    index = decontaminate.Index([(i, " ".join(f"w{i}x{k}" for k in range(20)).encode()) for i in range(50)])
    for _ in range(300):
        i, flips = int(rng.integers(50)), rng.choice(64, int(rng.integers(0, decontaminate.RADIUS + 1)), replace=False)
        probe = index.prints[i] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
        assert (0, i) in index.near(20, np.array([probe]))


# --- pipeline ------------------------------------------------------------------------------------


pipeline_is_there = pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="run from the repository")


@pipeline_is_there
def test_pipeline_stages_against_brute_force(spark, sf):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import corpus_pipeline as pipeline

    whole = spark.read.parquet(f"{sf}/documents.parquet")
    d, left, before = whole, {}, {}
    for name, stage in pipeline.STAGES:
        before[name] = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
        d = stage(spark, d, sf).cache()
        left[name] = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()} if name != "tokens" else {r["doc_id"]: r["token_ids"] for r in d.collect()}
        if name != "tokens":
            assert sorted(d.columns) == sorted(whole.columns)
    ids = [set(x) for x in left.values()]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and left["tokens"].keys() == left["decontamination"].keys() and 0 < len(ids[-1]) < whole.count()
    assert left["near_duplicates"].keys() == {c for _, c in brute_components(before["near_duplicates"], 5, (80, 100)).values()}
    gone = brute_repeats(before["repeats"], pipeline.REPEAT_BYTES)
    for i, text in before["repeats"].items():
        # a character goes only if all its bytes go
        starts = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        whole_gone = np.logical_and.reduceat(gone[i], starts) if len(starts) else np.zeros(0, bool)
        assert left["repeats"][i] == "".join(c for c, out in zip(text, whole_gone.tolist(), strict=True) if not out)
    assert any(x.any() for x in gone.values())
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"]]

    def leaks(text):
        w = words(text)
        for item in items:
            own, size = shingles(item), min(len(item), len(w))
            if size and own.keys() & shingles(w).keys() and max(sum((own & x).values()) / sum((own | x).values()) for k in range(len(w) - size + 1) for x in [shingles(w[k : k + size])]) >= 0.8:
                return True
        return False

    assert left["decontamination"].keys() == {i for i, text in before["decontamination"].items() if not leaks(text)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(pipeline.VOCABULARY)), special_tokens={})
    assert all(left["tokens"][i] == plain.encode_ordinary(text) for i, text in before["tokens"].items())
    ran = pipeline.run(spark, sf)
    assert ran.columns == ["doc_id", "n_tokens", "token_ids"] and {r["doc_id"]: r["token_ids"] for r in ran.collect()} == left["tokens"]


@pipeline_is_there
def test_pipeline_of_odd_and_empty_tables(spark, tmp_path, odd_documents):
    import corpus_pipeline as pipeline

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "an item that no document has in it", "x")], "item_id long, text string, key string")
    for name, docs in (("odd", odd_documents), ("none", odd_documents.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        rows = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in rows} <= {1, 2, 3, 5, 6, None} and len(rows) == len({r["doc_id"] for r in rows}) and bool(rows) == (name == "odd")


# --- very long texts -------------------------------------------------------------------------------


def long_text(words, seed):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(words))


def test_very_long_texts_of_joins_repeats_and_leaks(spark):
    body = long_text(200_000, 1)
    texts = [body, body + " and a few other words", long_text(100_000, 2), "short"]
    found = {r["doc_id"]: r for r in jaccard_join.join_components(docs(spark, texts), 4, (85, 100)).collect()}
    assert found[0]["component_id"] == found[1]["component_id"] == 0 and found[2]["component_id"] == 2 and found[0]["n_shingles"] == 199_997
    cut = {r["doc_id"]: r for r in run_index.dedup_digests(docs(spark, texts), length=50).collect()}
    n = len(body)
    assert cut[0]["n_removed"] == cut[2]["n_removed"] == 0 and cut[1]["n_removed"] == n and cut[1]["kept_sha256"] == hashlib.sha256(texts[1][n:].encode()).hexdigest()
    item = " ".join(body.split()[150_000:150_040])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    leaks = decontaminate.find_leaks(docs(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in leaks) == [(0, 7, 150_000), (1, 7, 150_000)]


def test_very_long_turns_and_tokens(spark):
    from stationflow.llm import byte_bpe

    body = long_text(150_000, 3)
    turns = spark.createDataFrame([(1, 0, "user", body), (1, 1, "assistant", "<s>" + body)], "conv_id long, turn long, role string, text string")
    r = chat_format.digests(turns).first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len(body) + 3 and r["loss_sha256"] == hashlib.sha256(("<s>" + body).encode()).hexdigest()
    import public_tokenizers

    d = byte_bpe.token_digests(docs(spark, [body]), public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).first()
    assert d["decoded_sha256"] == hashlib.sha256(body.encode()).hexdigest() and d["n_tokens"] > 150_000


def test_tables_left_behind_are_deleted(spark):
    from stationflow.llm import common

    before = common.written(spark)
    x = common.stored(spark.range(5))
    assert x.count() == 5 and common.written(spark) == before + 1
    common.forget(spark, before)
    assert common.written(spark) == before
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|No such file"):
        x.selectExpr("sum(id) AS s").collect()
