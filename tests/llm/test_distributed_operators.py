"""SimHash, embeddings, mixing, sharding and the pipeline against brute force."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from scamsift.llm import common, embed_dedup, langid, mixing, queries, secrets, sharding, simhash


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1001, None), (1002, ""), (1003, "É a"), (1004, "a"), (1004, "a"), (None, "a b c d")], "doc_id bigint, text string")
    rows = docs.union(extra).collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    found = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = defaultdict(list)
    for r, k in zip(rows, found):
        least[k].append(r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", min((x for x in least[k] if x is not None), default=None)) for r, p, k in zip(rows, prints, found))
    assert Counter(map(tuple, simhash.near_duplicates(docs.union(extra)).collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_of_dense_prints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.int64).astype(np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(120):
            x = b
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    found = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.fp: r.root for r in simhash.classes(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()}
    groups, mine = defaultdict(set), defaultdict(set)
    for s, k in zip(signed, found):
        groups[k].add(s)
        mine[got[s]].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_large_bucket_takes_the_other_path():
    rng = np.random.default_rng(5)
    block, width = 1, 16
    outside = np.uint64(rng.integers(0, 2**62)) & ~np.uint64(0xFFFF << width)
    flips = [0] + [1 << b for b in range(64) if not 16 <= b < 32]
    prints = np.unique(np.array([outside ^ np.uint64(flips[i]) | np.uint64(int(b) << width) for i, b in zip(rng.integers(0, 49, 4600), rng.integers(0, 65536, 4600))], dtype=np.uint64))
    assert len(prints) > 4096
    pairs = {(min(a, b), max(a, b)) for i, j in simhash._bucket(prints, block) for a, b in zip(i.tolist(), j.tolist())}
    want = set()
    for i in range(len(prints)):
        near = np.nonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3)[0] + i + 1
        want |= {(i, int(j)) for j in near}
    assert pairs == want


def plain_components(edges):
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    return {x: nodes[k] for x, k in zip(nodes, roots(len(nodes), [(at[a], at[b]) for a, b in edges if None not in (a, b) and a != b]))}


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    shuffled = rng.permutation(np.arange(3000, 4000)).tolist()
    chains = [(i, i + 1) for i in range(999)] + [(2000, 1999)] + list(zip(range(1999, 1000, -1), range(1998, 999, -1))) + list(zip(shuffled, shuffled[1:]))
    edges = chains + [(5000, 5000 + i) for i in range(1, 300)] + [(7, None), (None, None), (5, 5), (-3, -4)] + rng.integers(6000, 6400, (150, 2)).tolist()
    want = plain_components([tuple(e) for e in edges])
    df = spark.createDataFrame([tuple(e) for e in edges], "a bigint, b bigint").repartition(5)
    assert {r.node: r.root for r in common.components(df).collect()} == want
    assert {r.node: r.root for r in common.components(df, task_edges=300).collect()} == want  # by contraction
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common.joined, "__defaults__", ("inner", 10))
    star = spark.range(1, 100_001).selectExpr("0 AS a", "id AS b")
    assert common.components(star, task_edges=100).groupBy("root").count().collect() == [(0, 100_001)]  # a hot key, looked up
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_joins_with_hot_keys(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) AS k", "id AS v").union(spark.createDataFrame([(None, -1)], "k bigint, v bigint"))
    side = spark.range(1500).selectExpr("id AS k", "id * 2 AS w")
    for how in ("inner", "left"):
        got = Counter(map(tuple, common.joined(rows, side, "k", how, most=5).collect()))
        assert got == Counter(map(tuple, rows.join(side, "k", how).collect()))


def vectors():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(260, 16))
    for i in range(60, 160):
        x[i] = x[i % 12] + rng.normal(scale=0.09, size=16)
    x[200] = x[3]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(7, x[3].tolist()), (300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [1.0] * 4), (304, []), (305, [None] * 16), (306, [float("inf")] * 16), (None, x[5].tolist())]
    return rows


def test_embeddings_against_all_pairs(spark):
    rows = vectors()
    n = len(rows)

    def fine(v):
        return bool(v) and all(a is not None and np.isfinite(a) for a in v) and any(v)

    links, pairs = [0] * n, []
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if fine(a) and fine(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    found, least = roots(n, pairs), defaultdict(list)
    for i in range(n):
        least[found[i]].append(rows[i][0])
    want = Counter()
    for i in range(n):
        c = min((k for k in least[found[i]] if k is not None), default=None) if links[i] else rows[i][0]
        want[(rows[i][0], links[i], c, rows[i][0] is not None and c == rows[i][0])] += 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert Counter(map(tuple, embed_dedup.near_duplicates(df, leaf=8).collect())) == want
    assert Counter(map(tuple, embed_dedup.near_duplicates(df).collect())) == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_against_sql(spark, sf, tmp_path):
    df = spark.createDataFrame([(i, v) for i, v in vectors() if i is not None], "vec_id bigint, embedding array<double>")
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    wide = df.selectExpr("*", "1 AS v", "2 AS same", "3 AS c", "4 AS root", "5 AS KEPT")
    assert Counter(con.sql(embed_dedup.oracle()).fetchall()) == Counter(map(tuple, embed_dedup.near_duplicates(wide).collect()))
    con.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    assert Counter(con.sql(queries.oracle_sql()["op9_embedding_dedup"]).fetchall()) == Counter(map(tuple, queries.op9_embedding_dedup(spark, sf).collect()))


def test_clashing_columns_of_fingerprints_and_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z", 7, 8), (2, "a b c", "x", "y", "z", 7, 8), (3, None, "x", "y", "z", 7, 8)], "doc_id bigint, text string, fp string, __fp string, root string, __place int, __LANE int")
    assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [1, 1, 3]
    moved = sharding.shuffle_documents(docs.selectExpr("*", "5 AS Shard", "6 AS slot"), folder=f"{tmp_path}/s")
    assert moved.columns == [*docs.columns, "slot", "shard"] and Counter(tuple(r)[:-2] for r in moved.collect()) == Counter(map(tuple, docs.collect()))


CONTRACT = {
    "op3_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


def test_contract_of_all_queries(spark, sf):
    for name, want in CONTRACT.items():
        got = dict(queries.queries()[name](spark, sf).dtypes)
        assert {c: got.get(c) for c in want} == want, name


def test_embeddings_of_one_direction_and_narrow_trees(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 8))
    rows = [(int(i), (base[i % 3] * (1 + i)).tolist()) for i in range(240)] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    want = {rows[i][0]: int(near[i].sum()) - 1 for i in range(len(rows))}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for room in (embed_dedup.TREE_BYTES, 8 * 8 * 3):
        monkeypatch.setattr(embed_dedup, "TREE_BYTES", room)
        assert {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, leaf=8).collect()} == want
    tree, leaves = embed_dedup.grow(df.selectExpr("vec_id AS c", "embedding AS v"), 300, 8, 8, "array<float>")
    homes = embed_dedup.place(tree, unit, np.arange(300), 0.3, visits=False)[0]
    assert leaves > 10 and np.bincount(homes).max() <= 32


def test_mixing_margins_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cells = mixing.calibrated_cells(docs.select(*mixing.describe(docs)), None).toPandas()
    cells["w"] = cells.n * cells.factor / cells.n.sum()
    for m, p in mixing.POWERS.items():
        own = cells.groupby(m).n.sum().astype(float) ** p
        assert np.allclose(cells.groupby(m).w.sum(), own / own.sum(), atol=1e-6), m
    assert cells.prob.max() <= 1 and abs(cells.prob.max() - 1) < 1e-9
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, prob, sampled from ({mixing.oracle()})").fetchall()}
    got = {r.doc_id: (r.prob, r.sampled) for r in queries.op2_mixing(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in got)
    sampled = {r.doc_id for r in mixing.sample(docs).collect()}
    assert sampled == {k for k, v in got.items() if v[1]}


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "", "en", "a", "y"), (3, "w " * 5000, "en", "a", "z")] + [(None, f"word {i}", "en", "a", "y") for i in range(200)]
    names = "doc_id bigint, text string, lang string, source string"
    docs = spark.createDataFrame(rows, names + ", __topic string")
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 204 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(*r, "p", 1) for r in rows], names + ", __topic string, __cell string, __PROB int")
    assert mixing.sample(clash).columns == clash.columns
    free = [r.sampled for r in mixing.mix(docs, share=0.5).collect() if r.doc_id is None]
    assert 0 < sum(free) < len(free)  # documents without an id are drawn on their own


def test_raking_of_many_pairs_is_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null")
    cells = common.cut(docs.groupBy("source", "lang", (mixing.F.col("doc_id") % 3).cast("string").alias("topic")).agg(mixing.F.sum(mixing.tokens(mixing.F.col("text"))).alias("n")))
    targets = {m: mixing.tempered(cells, m, p) for m, p in mixing.POWERS.items()}
    short, long = ({(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, targets, sweeps=12, tolerance=0, short=n).collect()} for n in (10_000, 3))
    assert short.keys() == long.keys() and all(abs(short[k] - long[k]) < 1e-9 for k in short)
    with pytest.warns(mixing.NotConverged):
        mixing.rake(cells, targets, sweeps=1)


def test_topics(spark):
    texts = ["Licensed under the MIT License.", "plain words", None, "", "pay the bill with $5", "mail me @ home", "x = f();\nreturn y", "<div>a</div> href="]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.topic(mixing.F.col("t"))).collect()]
    assert got == ["license", "prose", "prose", "prose", "money", "contact", "code", "markup"]


def test_mixing_with_a_tiny_cell(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(9001, "one", "en", "a new source", 3)], docs.schema)).cache()
    cells = mixing.calibrated_cells(docs.select(*mixing.describe(docs)), least=p.LEAST_SHARE).toPandas()
    assert abs((cells.n * cells.prob).sum() / cells.n.sum() - p.LEAST_SHARE) < 1e-9 and cells.prob.max() == 1
    open_ = cells[cells.prob < 1]
    assert len(open_) and np.allclose(open_.prob / open_.factor, (open_.prob / open_.factor).iloc[0])
    low, high = 0.0, 1e9  # brute force: the budget by bisection
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (cells.n * np.minimum(1, cells.factor * mid)).sum() < p.LEAST_SHARE * cells.n.sum() else (low, mid)
    assert np.allclose(cells.prob, np.minimum(1, cells.factor * low))
    for share in (0.9, 1.0):
        part = mixing.calibrated_cells(docs.select(*mixing.describe(docs)), share=share).toPandas()
        assert abs((part.n * part.prob).sum() / part.n.sum() - share) < 1e-9
    kept = dict(p.STAGES)["mixing"](spark, docs, sf)
    words = mixing.tokens(mixing.F.col("text"))
    assert kept.select(mixing.F.sum(words)).first()[0] > 0.25 * docs.select(mixing.F.sum(words)).first()[0]


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None), (1, None), (None, "é")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(odd).repartition(7)
    rows = sharding.shuffle_rows(both, parts=5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in both.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    sizes = [len(slots[i]) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_rows(both.limit(0)).count() == 0
    assert sharding.shuffle_rows(odd).count() == 3


def test_sharding_moves_whole_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "é", None, "s", 1), (None, "é", None, "s", 1)], docs.schema)
    both = docs.union(odd).repartition(7)
    rows = sharding.shuffle_documents(both, folder=f"{tmp_path}/shards", parts=5)
    assert dict(rows.dtypes)["slot"] == "bigint" and Counter(tuple(r)[:-2] for r in rows.collect()) == Counter(map(tuple, both.collect()))
    assert len(list(tmp_path.glob("shards/shard=*"))) == 40
    assert sharding.shuffle_documents(both.limit(0)).count() == 0


def test_communication_matrix():
    counts = [5, 0, 17, 40, 1]
    total = np.zeros((5, 4))
    for seed in range(400):
        m = sharding.matrix(counts, 4, seed)
        assert (m.sum(axis=1) == counts).all() and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()
        total += m
    assert np.allclose(total / 400, np.array(counts)[:, None] / 4, atol=0.5)
    rng = np.random.default_rng(0)
    x = [sharding._draw(rng, 2 * 10**9, 3 * 10**9, 10**4) for _ in range(300)]
    assert abs(np.mean(x) - 4000) < 15 and 30 < np.std(x) < 70


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["language_id", "near_dedup", "secrets", "mixing", "bpe"]
    stages = dict(p.STAGES)
    odd = spark.createDataFrame([(5001, None, "en", "s", 0), (5002, "12 34", "en", "s", 5)], docs.schema)
    first = stages["language_id"](spark, docs.union(odd), sf)
    model = langid.train(docs.union(odd))
    kept = {r.doc_id for r in langid.identify(docs.union(odd), model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    ids = {r.doc_id for r in first.collect()}
    assert first.columns == docs.columns and ids == kept and not ids & {5001, 5002} and len(ids) >= docs.count() - 2
    again = docs.union(docs.limit(3))
    clashing = docs.selectExpr("*", "'a' AS __text", "'b' AS __topic", "'c' AS __row", "'d' AS __clean", "'e' AS __fp", "'f' AS __key")
    for name in ("language_id", "near_dedup", "secrets", "mixing"):
        assert stages[name](spark, clashing, sf).columns == clashing.columns and stages[name](spark, docs.limit(0), sf).count() == 0
    assert stages["near_dedup"](spark, clashing, sf).where("__row = 'c' and __fp = 'e'").count() == stages["near_dedup"](spark, docs, sf).count()
    assert stages["bpe"](spark, clashing.limit(0), sf).count() == 0
    second = stages["near_dedup"](spark, again, sf)
    classes = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in second.collect()) == sorted({r.component_id for r in classes}) and second.columns == docs.columns
    third = stages["secrets"](spark, docs, sf)
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in third.collect():
        assert r.text == secrets.redact_text(before[r.doc_id]) and secrets.scan(r.text) == [] and r.n_chars == len(r.text)
    fourth = stages["mixing"](spark, docs, sf)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == {r.doc_id for r in mixing.mix(docs).where("sampled").collect()}
    last = stages["bpe"](spark, docs.limit(20), sf)
    assert last.count() == 20 and {"doc_id", "token_ids"} <= set(last.columns)


def test_pipeline_run(spark, sf):
    import corpus_pipeline as p

    rows = p.run(spark, sf).toPandas()
    assert len(rows) and rows.doc_id.is_unique
