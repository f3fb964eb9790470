"""The operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import ann, chat, decontam, langid, license, mixing, pii, sharding, simhash, subdedup
from leafmill.llm._components import components

DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None, "x", 1),
    (2, "", "en", "s", None, 2),
    (None, "no id here", "en", None, "y", 3),
    (4, "same text of two rows", "en", "s", "z", 4),
    (4, "same text of two rows", "en", "s", "z", 4),
    (5, "12345 67890", "de", "s", "z", 5),
    (6, "word " * 60_000, "de", "s", "z", 6),
    (7, "你好 \U0001f600 é", "fr", "s", "z", 7),
]
#: Columns of the names that operators add or use inside.
DDL = "doc_id long, text string, lang string, source string, {}"


def odd(spark, clash="_text string, fingerprint int"):
    return spark.createDataFrame(ODD, DDL.format(clash))


def empty(spark):
    return spark.createDataFrame([], DDL.format("_text string, fingerprint int"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


# Language ID


def test_languages_of_held_out_rows(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = langid.identify(docs.where(held), langid.train(docs.where(~held))).collect()
    long = [r for r in out if r.n_chars >= 100]
    assert sum(r.lang == r.lang_pred for r in long) >= 0.97 * len(long)
    assert all(0 <= r.score <= 1 for r in out)


def test_code_lengths_match_a_plain_tree():
    texts = {"aa": ["the cat sat", "on the mat the end"], "bb": ["der hund und die", "katze der die das"]}
    langs = sorted(texts)

    def symbols(t):
        out = [0, 0, 0]
        for b in t.encode():
            c = int(langid._FOLD[b])
            if c != 32 or out[-1] != 32:
                out.append(c)
        return out

    seen = {}
    for lang in langs:
        for t in texts[lang]:
            f = symbols(t)
            for i in range(3, len(f)):
                for k in range(1, 5):
                    key = (langs.index(lang), tuple(f[i - k + 1 : i + 1]))
                    seen[key] = seen.get(key, 0) + 1
    rows = [(lang, len(g), int.from_bytes(bytes(g), "big"), n) for (lang, g), n in seen.items()]
    model = langid.freeze(langs, *map(np.array, zip(*rows)))

    def cost(lang, f, i):
        bits = 0.0
        for k in range(4, 0, -1):
            kids = {g[-1]: n for (m, g), n in seen.items() if m == lang and len(g) == k and g[:-1] == tuple(f[i - k + 1 : i])}
            if kids:
                n, t = sum(kids.values()), len(kids)
                if f[i] in kids:
                    return bits - np.log2(kids[f[i]] / (n + t))
                bits -= np.log2(t / (n + t))
        return bits + 8

    asked = ["The  hund sat!", "", "xyz é", "die katze  der"]
    ends = np.cumsum([0] + [len(t.encode()) for t in asked])
    got, _ = model.score(np.frombuffer("".join(asked).encode(), np.uint8), ends)
    for t, b in zip(asked, got):
        f = symbols(t)
        assert np.allclose(b, [sum(cost(x, f, i) for i in range(3, len(f))) for x in range(2)], atol=1e-3)


def test_language_of_odd_rows(spark, docs):
    out = langid.identify(odd(spark, "bits string, score int"), langid.train(docs)).collect()
    assert len(out) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 5)} == {1: "und", 2: "und", 5: "und"}
    none = langid.identify(odd(spark), langid.train(empty(spark))).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}


# Personal data


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_match_the_patterns():
    r = random.Random(1)
    for _ in range(5000):
        s = "".join(r.choice("@@a.1-. +(95é.%") for _ in range(r.randint(0, 50)))
        assert plain_spans(s) == pii.base_spans(s)


def test_long_runs_stay_linear():
    for s in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000):
        pii.find(s, pii.trained())


def test_added_spans_and_redaction(spark):
    rows = [(1, "mail bob.12 [at] foo [dot] com now"), (2, "call 415-555-1234 today"), (3, "Isbn 978-3-16-148410-0"), (4, "on 2024-01-02 03:04:05"), (5, None), (6, "a+b@x.co and 8.8.8.8")]
    out = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id int, text string"), redacted="safe").collect()}
    assert out[1].safe == "mail [EMAIL] now" and out[2].safe == "call [PHONE] today"
    assert out[3].spans == [] and out[4].spans == [] and out[5].safe == ""
    assert out[6].safe == "[EMAIL] and [IP]" and all(s.base for s in out[6].spans)
    assert pii.detect(odd(spark, "spans string, x int")).count() == len(ODD) and pii.detect(empty(spark)).count() == 0


# Mixing


def test_raked_marginals_meet_their_targets(spark):
    r = random.Random(3)
    rows = [(a, b, c, float(r.randint(1, 100))) for a in "xyz" for b in ("en", "de") for c in "pq"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    goal = {"source": {"x": 0.5, "y": 0.3, "z": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": 0.0}
    out = mixing.rake(cells, goal, sweeps=30).cache()
    for d, want in goal.items():
        got = {r[0]: r[1] for r in out.groupBy(d).agg(F.sum("weight")).collect()}
        for k, v in (want or {"p": 0.5, "q": 0.5}).items():
            assert got[k] == pytest.approx(v, abs=1e-6)
    left = {(r.dim, r.value): r.target - r.share for r in mixing.residuals(cells, out, goal).collect()}
    assert len(left) == 7 and all(abs(v) < 1e-6 for v in left.values())
    early = [abs(r.target - r.share) for r in mixing.residuals(cells, mixing.rake(cells, goal, sweeps=1), goal).collect() if r.dim != "topic"]
    assert max(early) > 1e-4


def test_mixing_odd_rows(spark):
    out = mixing.mix(odd(spark, "topic string, _draw int")).collect()
    assert len(out) == len(ODD) and all(r.sampled for r in out if not r.tokens) and {r.topic for r in out if not r.text} == {"empty"}
    assert mixing.mix(empty(spark)).count() == 0


# Sharding


def test_shards_are_contiguous_and_even(spark, docs):
    out = sharding.assign_shards(docs.union(docs.limit(50)), 24).collect()
    assert sorted(r.id for r in out) == sorted([r.doc_id for r in docs.collect()] + [r.doc_id for r in docs.limit(50).collect()])
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    total = 0
    by = {}
    for r in out:
        raw = text[r.id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
        total += r.size
    largest = max(r.size for r in out)
    for s, rows in by.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 24) <= largest + 2 * sharding.WHOLE * total / 24


def test_shards_of_odd_rows(spark):
    out = sharding.assign_shards(odd(spark, "_size int, _hash int".replace("_size int", "_size string")), 3).collect()
    assert len(out) == len(ODD) and {r.size for r in out if r.id in (1, 2)} == {8}
    assert sharding.assign_shards(empty(spark), 24).count() == 0


# SimHash


def plain_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(x) for x in zip(w, w[1:], w[2:])] or [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, docs):
    r = random.Random(2)
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    for i, (_, t) in enumerate(rows[:40]):
        w = (t or "").split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "one"), (2002, "one")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    fp = {i: plain_print(t) for i, t in rows}
    assert all(f.fp % 2**64 == fp[f.id] for f in out)
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {f.id: f.component_id for f in out} == {i: find(i) for i in ids}


def test_links_of_every_distance(spark):
    """A chain of fingerprints 1, 2 and 3 bits apart holds together; 4 bits part."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    want = []
    for b in base:
        x = b
        for far in (1, 2, 3, 3):
            y = x ^ sum(1 << k for k in r.sample(range(64), far))
            want.append((x, y))
            x = y
        want.append((x ^ 0b1111 << r.randrange(60), None))
    prints = {v for p in want for v in p if v is not None} | set(base)
    signed = lambda v: v - (1 << 64) * (v >> 63)
    df = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    got = {x.node % 2**64: x.root for x in components(simhash.links(df)).collect()}
    brute = {a: {b for b in prints if (a ^ b).bit_count() <= 3} for a in prints}
    for a in prints:
        group, todo = {a}, [a]
        while todo:
            for b in brute[todo.pop()] - group:
                group.add(b)
                todo.append(b)
        assert got.get(a, signed(a)) == min(map(signed, group))


def test_simhash_odd_rows(spark):
    out = simhash.near_duplicates(odd(spark)).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 240), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination


def test_hits_point_into_the_original(spark):
    item = "one Two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, "!!")], "item_id int, text string")
    texts = ["a, ONE two-three four; five six seven eight nine ten! b", "x short...ITEM y", "one two three", None, "é short item"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("hits", F.lit(1))
    out = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    assert [out[i].n_hit for i in range(5)] == [10, 2, 0, 0, 2] and [out[i].items for i in range(5)] == [["1"], ["2"], [], [], ["2"]]
    h = out[0].hits[0]
    assert texts[0][h.start : h.end] == "ONE two-three four; five six seven eight nine ten"
    h = out[4].hits[0]
    assert texts[4][h.start : h.end] == "short item"
    assert decontam.contamination(odd(spark), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.contamination(empty(spark), bench).count() == 0


def test_passes_find_what_one_automaton_finds(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((h.start, h.end) for h in r.hits))
    whole = sorted(map(key, decontam.contamination(docs, bench, keep=["doc_id"]).collect()))
    monkeypatch.setattr(decontam, "MAX_CHARS", bench.agg(F.sum(F.length("text"))).first()[0] // 3)
    assert sorted(map(key, decontam.contamination(docs, bench, keep=["doc_id"]).collect())) == whole and any(r[2] for r in whole)


# Nearest neighbours


def test_recall_ties_and_scores(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 32)).round(3)
    x[700:720] = x[699]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [1.0]), (5200, [])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, sample=1000).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        mine = sorted((o for o in out if o.query_id == q), key=lambda o: o.rank)
        assert [o.rank for o in mine] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(mine, mine[1:]))
        s = unit @ unit[q]
        s[q] = -9
        hit += len({o.vec_id for o in mine} & set(np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist()))
        assert all(o.score == pytest.approx(s[o.vec_id], abs=1e-12) for o in mine)
    assert hit >= 0.9 * 5 * 30
    assert [o.vec_id for o in sorted(out, key=lambda o: o.rank) if o.query_id == 700] == [699, 701, 702, 703, 704]
    assert {o.query_id for o in out} == set(range(0, 1500, 50))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(o.query_id, o.vec_id) for o in ann.search(few, F.col("id") == 0).collect()] == [(0, 1)]
    assert ann.search(few.limit(0), F.col("id") == 0).count() == 0


# Licenses


def test_license_blocks(spark):
    texts = ["Released under the MIT license.\nAll rights, RESERVED", "released under no license", None, "", "cc by cc-by x", "x" * 100_000]
    out = {r.doc_id: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("score", F.lit("s"))).collect()}
    assert [(m.at, m.label, m.score) for m in out[0].matches] == [(0, "mit", 1.0)]
    assert [(p.label, p.at) for p in out[0].places] == [("reserved", 5)] and out[0].score == 1.0
    assert out[1].matches == [] and out[2].n_words == 0 and out[3].score == 0.0 and [p.at for p in out[4].places] == [0, 2]
    assert license.scan(empty(spark)).count() == 0 and license.scan(odd(spark)).count() == len(ODD)


# Paragraphs


def test_paragraph_components_match_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(r.randint(50, 90))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(base[i % 12])
        for _ in range(r.choice((0, 0, 1, 2, 6))):
            w[r.randrange(len(w))] = word()
        rows.append((i, "short line\n" + " ".join(w) + "\n" + " ".join(word() for _ in range(40))))
    rows += [(100, None), (101, ""), (102, "short"), (103, rows[0][1]), (103, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = subdedup.repeated(df).where("number = 1").select("id", "cluster", "count", "kept").collect()
    lines = {i: t.split("\n")[1].encode() for i, t in rows if t and "\n" in t}
    group = {i: {j for j in lines if subdedup.jaccard(lines[i], lines[j]) >= 0.8} for i in lines}
    changed = True
    while changed:
        changed = False
        for i in group:
            wide = set().union(*(group[j] for j in group[i]))
            changed |= wide != group[i]
            group[i] = wide
    got = {}
    for o in out:
        got.setdefault(o.cluster, set()).add(o.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, {tuple(sorted(g)) for g in group.values()}))
    for cluster, ids in got.items():
        kept = [o for o in out if o.cluster == cluster and o.kept]
        assert {o.id for o in kept} == {min(ids)}
    docs = {r.id: r for r in subdedup.by_document(subdedup.repeated(df)).collect()}
    assert {docs[i].n_paragraphs for i in (100, 101, 102)} == {0} and docs[103].n_removed == docs[103].n_paragraphs > 0
    assert subdedup.by_document(subdedup.repeated(empty(spark))).count() == 0


# Chat


def test_branches_and_round_trip(spark):
    rows = [
        ("t", 1, None, 0.0, "user", "hi"), ("t", 2, 1, 1.0, "assistant", "a\\<|im_end|>"), ("t", 3, 1, 5.0, "assistant", "better"), ("t", 4, 3, 1.0, "user", None),
        ("t", 5, 4, 0.5, "assistant", "\n"), (None, 1, 99, None, "sys\ntem", "x"), ("u", 1, None, 0.0, None, "<|"),
    ]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, content string")
    out = {(r.tree, r["rank"]): r for r in chat.format_paths(m, chat.paths(m, branches=2)).collect()}
    assert {k: (r.leaf, r.path_score) for k, r in out.items()} == {("t", 1): (5, 6.5), ("t", 2): (2, 1.0), (None, 1): (1, 0.0), ("u", 1): (1, 0.0)}
    read = spark.createDataFrame([(r.tree, r.text, r.loss_spans) for k, r in out.items() if k[1] == 1], "tree string, text string, spans array<struct<start:bigint,end:bigint>>")
    got = {r.tree: r for r in read.select("tree", chat.read_turns(F.col("text")).alias("turns"), chat.loss_text(F.col("text"), F.col("spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got["t"].turns] == [("user", "hi"), ("assistant", "better"), ("user", ""), ("assistant", "\n")]
    assert got["t"].loss == "better\n" and got[None].turns[0].role == "sys\ntem" and got["u"].turns[0].text == "<|"
    assert out["t", 2].text.endswith("<|im_start|>assistant\na\\\\<\\|im_end|><|im_end|>\n")


def test_long_chain_and_cycle(spark):
    m = spark.range(1, 301).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    c = chat.conversations(m)
    assert chat.format_paths(c, chat.paths(c)).select(F.size(chat.read_turns(F.col("text")))).first()[0] == 300
    assert chat.paths(chat.conversations(m.limit(0))).count() == 0
    loop = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "tree int, node long, parent long").withColumn("score", F.lit(0.0))
    with pytest.raises(ValueError):
        chat.paths(loop)


def test_digests_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
