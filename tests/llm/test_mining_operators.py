import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationflow.llm import collocations, hard_negatives, lm_score, queries, words

SF1 = "/root/testdata/sf0.01"


def same_as_sql(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF1}/{t}.parquet'")
    expected = con.sql(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    got = queries.QUERIES[name](spark, SF1).toArrow().to_pylist()
    key = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert key(got) == key(expected) and expected


# --- hard negatives ------------------------------------------------------------------------------


def brute_negatives(rows, n_pos=5, n_neg=3):
    seen, kept = set(), []
    for v, label, x in rows:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        if (v, label, q) not in seen:
            seen.add((v, label, q))
            kept.append((v, label, q))
    anchors = {}
    for v, label, q in kept:
        if v % 50 == 0:
            anchors[v] = min(anchors.get(v, (label, q)), (label, q))
    out = set()
    for a, (label, q) in anchors.items():
        scored = {(sum(x * y for x, y in zip(q, r, strict=False)), v, other == label) for v, other, r in kept if v != a}
        order = sorted(scored, key=lambda x: (-x[0], x[1]))
        for s, p, _ in [x for x in order if x[2]][:n_pos]:
            fitting = [(ns, v) for ns, v, same in order if not same and 50 * s <= 100 * ns <= 95 * s]
            out.update((a, p, k, v, s, ns) for k, (ns, v) in enumerate(fitting[:n_neg], 1))
    return out


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"anchor": F.lit("x"), "key": F.lit(1), "rank": F.lit(2)})


def some_vectors(n=600, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    return [(i, rng.randrange(4), [round(c + rng.gauss(0, 0.7), 1) for c in centres[rng.randrange(4)]]) for i in range(n)]


def test_negatives_against_sql(spark):
    same_as_sql(spark, "op11_hard_negatives", ["embeddings"])


def test_negatives_against_brute_force(spark):
    rows = some_vectors()
    # nulls, non-finite components, repeated rows, many equal vectors (ties), vectors of other lengths, zero vectors
    rows += [(700, None, [1.0] * 6), (None, 1, [1.0] * 6), (701, 1, None), (702, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (703, 1, [float("nan")] * 6), (704, 1, [float("inf")] * 6)]
    rows += [(i, i % 3, [0.5, 0.5, -0.5, 0.5, 0.0, 0.1]) for i in range(800, 900)] + rows[:40] + [(950, 2, [0.0] * 6), (951, 2, [0.0] * 6), (952, 1, [0.0] * 6), (1000, 3, []), (1001, 3, [1.5, -0.5]), (1002, 1, [2.0] * 9)]
    got = hard_negatives.mine(vectors_table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows) and len(got) == len(set(map(tuple, got)))
    assert any(r["positive_score"] == 0 for r in got)


def test_negatives_in_blocks_of_anchors(spark, monkeypatch):
    rows = some_vectors(400, 5)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    got = hard_negatives.mine(vectors_table(spark, rows), F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows)


def test_negatives_of_empty_tables_and_no_anchor(spark):
    t = vectors_table(spark, some_vectors(30))
    assert hard_negatives.mine(t.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(t, F.lit(False)).count() == 0
    assert hard_negatives.mine(t.where("vec_id % 50 = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 30), 1 << 30, (5, 3)).astype(float), rng.integers(-(1 << 30), 1 << 30, (4, 3)).astype(float)
    expected = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert hard_negatives.inner_products(a, b).tolist() == expected
    with pytest.raises(OverflowError):
        hard_negatives.inner_products(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))


def test_keys_sort_by_anchor_falling_score_kind_and_id():
    rng = random.Random(1)
    rows = [(rng.choice([-(1 << 63), -5, 0, 7, (1 << 63) - 1]), rng.choice([-(1 << 63), -3, 0, 2, (1 << 63) - 1]), rng.randrange(2), rng.choice([-9, 0, 4])) for _ in range(300)]
    keys = [hard_negatives.pack(np.array([a]), np.array([s]), k, np.array([i])).to_pylist()[0] for a, s, k, i in rows]
    order = sorted(range(len(rows)), key=lambda x: keys[x])
    back = list(zip(*(x.tolist() for x in hard_negatives.unpack(pa.array([keys[i] for i in order]))), strict=True))
    assert back == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


# --- collocations --------------------------------------------------------------------------------


def brute_phrases(rows, least, overlap=80, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            score, cut = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= overlap * a for q, b in found.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def some_texts(n=150, seed=8):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "ünï", "a", "b\x0bc", "x\x00y", "état", "\U0001f600"]
    common = "the state of New york city"
    out = []
    for _ in range(n):
        parts = [rng.choice(vocabulary) if rng.random() < 0.8 else common for _ in range(rng.randrange(40))]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]) for w in parts))
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, chunk string, n int")
    return sorted(tuple(r) for r in collocations.mine(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_against_sql(spark):
    same_as_sql(spark, "op12_collocations", ["documents"])


def test_phrases_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["en", "fr", None]), t) for t in some_texts()] + [("en", None), ("en", ""), (None, " .,; "), ("de", "word " * 3000), ("de", "w" * 100_000)]
    rows += rows[:30]
    assert mined(spark, rows, least=5) == brute_phrases(rows, 5)
    assert mined(spark, rows, least=9, overlap=50, top=7) == brute_phrases(rows, 9, 50, 7)


def test_phrases_of_empty_tables(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_every_occurrence_is_in_one_chunk():
    texts = [t.encode() for t in some_texts(60, 4)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found, last, doc = collocations.chunks(raw, offsets)
    got = collections.Counter()
    for chunk, ends in zip(found.to_pylist(), last.tolist(), strict=True):
        w = chunk.split(b" ")
        own = len(w) if ends else len(w) - collocations.OVERLAP
        got.update((k, tuple(w[i : i + k])) for k in range(1, 5) for i in range(own) if i + k <= len(w))
    expected = collections.Counter()
    for t in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t.translate(bytes(words.LOWER))):
            w = re.findall(rb"[^\x20\x09]+", piece)
            expected.update((k, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == expected and not all(last) and len(doc) == len(last)
    # no chunk of the parse is a prefix of another, but where a piece ends
    inner = sorted({c.split(b" ") and c for c, e in zip(found.to_pylist(), last.tolist(), strict=True) if not e})
    assert not any(b.startswith(a + b" ") for a, b in zip(inner, inner[1:], strict=False))


# --- language model ------------------------------------------------------------------------------


def brute_base(train, texts):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [" "]
    c = collections.Counter(w for t in train for w in token(t))
    n, v = sum(c.values()), len(c)
    return [(len(token(t)), sum(c[w] > 0 for w in token(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t))) for t in texts]


def brute_score(train, text):
    """The model from exact tables of counts, quantised."""
    token = lambda t: ["<", "<", *re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), " "]
    c = collections.Counter()
    for t in train:
        w = token(t)
        c.update((w[i],) for i in range(1, len(w)))
        c.update(tuple(w[i - 1 : i + 1]) for i in range(1, len(w)))
        c.update(tuple(w[i - 2 : i + 1]) for i in range(2, len(w)))
    types = len({k[0] for k in c if len(k) == 1 and k[0] != "<"})
    tokens = sum(n for k, n in c.items() if len(k) == 1 and k[0] != "<")
    q = {k: (2 ** (n.bit_length() - 1) + 2 ** n.bit_length() - 1) / 2 for k, n in c.items()}
    get = lambda *k: q.get(k, 0.0)
    total, w, m = 0.0, token(text), lm_score.WEIGHT
    for i in range(2, len(w)):
        a, b, x = w[i - 2 : i + 1]
        p = min(1.0, (get(x) + 1) / (tokens + types + 1))
        p = (min(get(b, x), get(b)) + m * p) / (get(b) + m)
        p = (min(get(a, b, x), get(a, b)) + m * p) / (get(a, b) + m)
        total += math.log10(p)
    return total


def scored(spark, train, texts, **more):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(train)], "doc_id long, text string, token string, n int")
    model = lm_score.learn(df, **more)
    rows = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, n_tokens int")
    return model, sorted(tuple(r) for r in lm_score.score(rows, model).collect())


def test_scores_against_plain_loops(spark):
    train = [*some_texts(200, 1), None, "", "odd ones out " * 3]
    texts = [*some_texts(40, 2), None, "", "never seen words here", "The THE the", "ab" * 200_000, "of the " * 20_000, "ünï ünï"]
    _, got = scored(spark, train, texts, bits=400)
    for row, base, text in zip(got, brute_base(train, texts), texts, strict=True):
        assert row[1:4] == base[:3] and row[4] == pytest.approx(base[3], rel=1e-9)
        assert row[5] == pytest.approx(brute_score(train, text), rel=1e-6, abs=1e-6) and row[5] <= 0


def test_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    train, texts = some_texts(200, 1), [*some_texts(30, 2), "", None]
    model, one = scored(spark, train, texts, bits=400)
    assert model.n_slices > 4
    monkeypatch.setattr(lm_score, "BLOCK_SLICES", 3)
    assert scored(spark, train, texts, bits=400)[1] == one


def test_filter_misses_no_ngram_and_invents_few():
    rng = np.random.default_rng(5)
    h, counts = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)), None
    counts = rng.integers(1, 200, len(h))
    block = lm_score.FilterBlock(lm_score.slice_bits(lm_score.short(h[:15_000]), counts[:15_000]), 0, 1)
    got, true = block.levels(h[:15_000]), np.floor(np.log2(counts[:15_000])).astype(int) + 1
    assert (got >= true).all()
    sparse = lm_score.FilterBlock(lm_score.slice_bits(lm_score.short(h[:3000]), counts[:3000]), 0, 1)
    assert (sparse.levels(h[:3000]) == np.floor(np.log2(counts[:3000])).astype(int) + 1).mean() > 0.97 and (sparse.levels(h[3000:]) > 0).mean() < 0.03


def test_an_empty_model_and_no_texts(spark):
    _, got = scored(spark, [], ["a b", None])
    assert [r[1:5] for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert scored(spark, ["a b"], [])[1] == []


def test_query_beats_the_base_on_documents_it_has_not_seen(spark):
    rows = queries.op13_lm_score(spark, SF1).toArrow().to_pylist()
    new = [r for r in rows if r["held_out"]]
    assert len(new) > 100 and sum(r["score"] for r in new) > sum(r["base_score"] for r in new) and len(rows) == spark.read.parquet(f"{SF1}/documents.parquet").count()
    texts = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text", lm_score.held_out().alias("held_out")).collect()
    expected = brute_base([r["text"] for r in texts if not r["held_out"]], [r["text"] for r in texts])
    got = {r["doc_id"]: r for r in rows}
    for r, (n, known, total, base) in zip(texts, expected, strict=True):
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n, known, total) and x["base_score"] == pytest.approx(base, rel=1e-9)
