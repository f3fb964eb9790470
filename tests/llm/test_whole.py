"""Operators do the whole job: cases that a narrower rule would miss."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import ann, license, mixing, pii, subdedup


def test_passages_are_found_wherever_lines_break(spark):
    r = random.Random(11)
    words = lambda n: ["".join(r.choice("abcdéfgh") for _ in range(6)) for _ in range(n)]
    shared, wrapped, short = words(57), words(51), words(29)
    fold = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = {
        1: " ".join(words(80) + shared + words(3)),  # inside longer lines
        2: " ".join(words(5) + [w.upper() if w.isascii() else w for w in shared] + words(90)),
        3: fold(words(7) + wrapped + words(9), 12),  # over lines of under 30 words
        4: fold(words(40) + wrapped, 10),
        5: " ".join(words(60) + short),
        6: " ".join(short + words(60)),
        7: "go round " * 4000,
        8: None,
        9: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.id: x for x in subdedup.passages(df).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    assert [(got[i].n_passages, got[i].passage_ids) for i in (1, 2, 3, 4)] == [(0, [1]), (1, [1]), (0, [3]), (1, [3])]
    for i, whole in ((2, shared), (4, wrapped)):
        a, b = map(int, got[i].passages.split(":"))
        run = texts[i][a:b].lower().split()
        assert len(run) >= 30 and " ".join(run) in " ".join(whole)
    assert got[7].passages == f"{got[7].passages.split(':')[0]}:{got[7].passages.split(':')[-1]}" and got[7].n_passages == 1


def test_every_run_of_51_words_is_found():
    r = random.Random(12)
    word = lambda: r.choice("abc").encode()
    for size in range(51, 60):
        for _ in range(40):
            run = [word() for _ in range(size)]
            a, b = ([*[word() for _ in range(r.randrange(70))], *run, *[word() for _ in range(r.randrange(70))]] for _ in range(2))
            x, y = ({*subdedup.anchors(b" ".join(w))[0].tolist()} for w in (a, b))
            assert x & y
    assert not len(subdedup.anchors(b" ".join(run[:50]))[0])


def test_near_dedup_keeps_one_document_of_each_component(spark):
    r = random.Random(13)
    one, two, three, four, five = (" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(5))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (8, three), (9, four), (None, four), (6, five), (7, five)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == sorted([(0, one), (0, two), (7, three), (7, four), (6, five)])


def test_wrapped_license_texts_are_found(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "x\n\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    narrow = "\n".join("licensed under the Mozilla public license version 2 0".split())
    apart = "Redistribution and use in source and binary forms\n\nwith or without modification are permitted"
    far = "released under the\n" + "other words " * 10 + "\nmit license"
    bag = "public license version under the word word word word word word mozilla 2 0 licensed"
    kelvin = "thi\u212a wor\u212a is licensed under cc by nc 4 \uff10"  # letters that fold into ASCII are no ASCII
    texts = [mit, bsd, narrow, apart, far, mit.replace("\n", " ") + "\nmore", bag, kelvin, None, "", ".released UNDER the mit license."]
    out = {r.doc_id: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    found = [[(m.at, m.label, m.score) for m in out[i].matches] for i in range(len(texts))]
    assert found == [[(0, "mit", 1.0)], [(1, "bsd", 1.0)], [(0, "mpl-2.0", 1.0)], [(0, "bsd", 1.0)], [], [(0, "mit", 1.0)], [], [], [], [], [(0, "mit", 1.0)]]
    assert [out[i].n_words for i in (7, 8, 9, 10)] == [10, 0, 0, 5]
    many = {f"word{i} of the list {i} stands here {i * 7}": f"label{i}" for i in range(400)}
    some = spark.createDataFrame([(0, "x word17 of the list 17 stands here 119 x"), (1, "word17 of the list 18 stands there 119")], "doc_id int, text string")
    assert {r.doc_id: [m.label for m in r.matches] for r in license.scan(some, templates=many, phrases={}).collect()} == {0: ["label17"], 1: []}


def test_probabilities_hold_the_share_however_many_cells_stay_whole(spark):
    tokens = [1.5**k for k in range(9)]
    total = sum(x**0.2 for x in tokens)
    cells = spark.createDataFrame([(f"s{k}", "en", "prose", x, x**0.2 / total) for k, x in enumerate(tokens)], "source string, lang string, topic string, tokens double, weight double")
    for keep in (0.05, 0.3, 0.7, 0.9, 0.95, 1.0):
        got = mixing.probabilities(cells, keep).collect()
        assert abs(sum(r.tokens * r.prob for r in got) - keep * sum(tokens)) < 1e-6 * sum(tokens)
        part = [r.prob * r.tokens / r.weight for r in got if r.prob < 1]
        assert not part or max(part) - min(part) < 1e-6 * max(part)


def test_crowds_of_near_copies_and_wrapped_paragraphs(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = {}
    for i in range(150):  # every copy changes a word or two at other places, so many pairs are just under the similarity
        w = list(base)
        for _ in range(r.choice((1, 2, 2))):
            w[r.randrange(60)] = word()
        texts[i] = " ".join(w)
    short = [word() for _ in range(40)]
    fold = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts |= {200: fold(short, 9), 201: fold([word(), *short[1:]], 11), 202: "one two\n\n" + fold(short, 7), 203: "\n\n".join(" ".join(short[i : i + 8]) for i in range(0, 40, 8))}
    rows = subdedup.repeated(spark.createDataFrame([(f"d{i}", t) for i, t in texts.items()], "doc_id string, text string")).collect()
    root = {i: i for i in range(150)}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(150):
        for j in range(i):
            if subdedup.jaccard(texts[i].encode(), texts[j].encode()) >= 0.8:
                root[top(i)] = top(j)
    mine = {}
    for x in rows:
        if int(x.id[1:]) < 150:
            mine.setdefault(x.cluster, set()).add(int(x.id[1:]))
    whole = {}
    for i in range(150):
        whole.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, whole.values()))
    late = {x.id: x for x in rows if int(x.id[1:]) >= 200}
    assert late["d200"].cluster == late["d201"].cluster == late["d202"].cluster and late["d202"].number == 2 and late["d203"].number is None


def test_repeated_queries_and_the_probing_radius(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist()), (100, x[7].tolist()), (7, x[7].tolist())]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert sorted(o["rank"] for o in out if o.query_id == 50) == [1, 2, 3, 4, 5]
    assert sorted(o["rank"] for o in out if o.query_id == 100) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # two queries of one id
    assert [(o["rank"], o.vec_id) for o in out if o.query_id == 100 and o.score > 0.999999] == [(1, 7), (2, 7)]
    text = spark.createDataFrame([("0", [1.0, 0.0]), ("x", [1.0, 0.1]), ("2", [1.0, 1.0])], "vec_id string, embedding array<double>")
    assert [(o.query_id, o.vec_id) for o in ann.search(text, F.col("id") == 0).collect()] == [(0, 2)]

    coder = ann.learn(ann.unit(x))
    codes = coder.codes(ann.unit(x))
    index, near = ann.Index(codes, coder.size), ann.flips(coder.size, coder.most)
    for n in range(0, 400, 40):
        apart = ann._POP[codes ^ codes[n]]
        assert set(np.flatnonzero(apart.sum(1) <= coder.radius)) <= set(index.probe(codes[n], near)) == set(np.flatnonzero((apart <= coder.most).any(1)))


def test_trees_decide_on_personal_data_and_secrets(spark):
    trees = pii.trained()
    assert len({round(t, 6) for t in trees.threshold.values()}) == len(pii.ALL_KINDS)  # calibrated, each on its own
    for kind, (precision, recall) in pii.quality(trees).items():
        assert precision >= 0.93 and recall >= 0.93, kind
    found = lambda t: [(k, t[a:b]) for k, a, b, *_ in pii.find(t, trees)]
    key = "AKIA" + "PTDW4XUFB63SMKLH"
    assert found(f'und token = "2b0cb261201f091f991b2c1144c292e775ffe40a" thly') == [("secret", "2b0cb261201f091f991b2c1144c292e775ffe40a")]
    assert found(f"the {key} thly") == [("secret", key)]
    assert found("die 9807915762804490 raie") == [("account", "9807915762804490")]
    for clean in ("see commit 2b0cb261201f091f991b2c1144c292e775ffe40a of it", "password: required", "order 980791576280 shipped", "Version 2.0 of 2024-01-02", "ANSHHA!! ERAN!! THTHLYEA!!"):
        assert not found(clean), clean
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.detect(docs.select("doc_id", "text"), keep=["doc_id"]).where("size(spans) > 0").collect()
    assert sum(not s.base for r in rows for s in r.spans) > 10
    twice = pii.detect(docs.limit(3).union(docs.limit(3)), keep=["doc_id"]).collect()
    assert len(twice) == 6 and pii.detect(docs.limit(0)).count() == 0
