"""Manifests, archives and conversation tries against plain versions."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontam, merkle, pii, prefix_trie, sharding, structure_queries, warc

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain_manifest(rows, fanout):
    groups = {}
    for g, i, leaf, extra in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, extra))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for j in range(len(paths)):
                a = at[j] - at[j] % fanout
                run = nodes[a : a + fanout]
                paths[j].append(("".join(run[: at[j] - a]), "".join(run[at[j] - a + 1 :])))
                at[j] //= fanout
            nodes = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        return nodes[0], paths

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, up = tree([sub[g][0] for g in order])
    return [(g, x[1] if x[0] else None, x[2], x[3], sub[g][0], root, tuple(p + up[k])) for k, g in enumerate(order) for x, p in zip(sorted(groups[g]), sub[g][1])]


KIND = "grp string, id long, leaf string, extra string"


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_is_the_plain_tree(spark, fanout):
    r = random.Random(fanout)
    rows = []
    for g, n in ((None, 3), ("", 1), ("a", 400), ("b", 257), ("ab", 2), ("é", 5)):
        rows += [(g, r.choice([None, r.randrange(-(2**63), 2**63), r.randrange(50), 7]), H(str(r.randrange(400))), r.choice(["", "x"])) for _ in range(n)]
    rows += [("b", 7, H("z"), "")] * 3 + [("a", 5, H(str(k)), "") for k in range(400)]  # repeated rows, one id with many rows
    order = lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0, x[2:])
    out = merkle.manifest(spark.createDataFrame(rows, KIND), fanout)
    got = [(x.grp, x.id, x.leaf, x.extra, x.subroot, x.root, tuple((s.left, s.right) for s in x.sibs)) for x in out.collect()]
    assert sorted(got, key=order) == sorted(plain_manifest(rows, fanout), key=order)
    again = out.select("root", merkle.folded(F.col("leaf"), F.col("sibs")).alias("a"), merkle.folded(F.lit("0"), F.col("sibs")).alias("b"))
    assert again.where("a = root and b != root").count() == len(rows)


def test_manifest_of_little(spark):
    assert merkle.manifest(spark.createDataFrame([], KIND)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(None, None, H("x"), "")], KIND)).first()
    assert one.sibs == [] and one.subroot == one.root == H("x")
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], KIND), 1)


def test_leaves_of_odd_rows(spark, tmp_path):
    rows = [(1, "aé", None, "s", 2), (None, None, None, None, None), (7, "", "en", "", None), (7, "", "en", "", None), (-3, "x" * 100_000, "en", "s", 1)]
    df = spark.createDataFrame([(*r, "odd") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = structure_queries.op11_merkle(spark, str(tmp_path)).collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(x.leaf for x in got) == sorted(H(*map(enc, (i, s, lang, n, t))) for i, t, lang, s, n in rows)
    tampered = [i for i, t, lang, s, n in rows if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0]
    assert sorted(x.doc_id for x in got if not x.verified) == sorted(tampered)


TRAP = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>"


def page_rows():
    long, other = "yé" * 700, "z" * 1000
    return [(1, "http://a.b/c d", long), (2, "http://a.b/", long), (5, None, long), (3, "u", TRAP), (4, "http://x", TRAP), (6, "v", ""), (7, "v", None), (None, "w", other), (8, "w", other), (9, "q", "z" * 999), (10, "q", "z" * 999), (11, "big", "\r\n" * 200_000), (12, "r", "t" * 1000), (12, "r", "t" * 1000), (12, "a", "t" * 1000)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([(*r, "clash") for r in page_rows()], "page_id long, url string, html string, digest string")
    warc.write(df, str(tmp_path / "w"), records_per_file=7, compression=compression)
    rows = warc.read(spark, str(tmp_path / "w"))
    assert rows.count() == 3 * len(page_rows()) and rows.where("not intact").isEmpty()
    got = warc.captures(rows).collect()
    assert len(got) == len(page_rows())
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    back = []
    for x in got:
        assert len(x.requests) == len(x.metadata) == 1
        page = x.metadata[0].payload.decode().strip().removeprefix("page_id: ")
        back.append((int(page) if page else None, x.capture.type, x.capture.payload_bytes, x.capture.payload_digest, x.capture.payload.decode() if x.capture.type == "response" else None))
    expected = []
    for i, url, html in page_rows():
        text = html or ""
        raw, same = text.encode(), [(a or -1, b or "") for a, b, h in page_rows() if (h or "") == text]
        whole = len(raw) < 1000 or (i or -1, url or "") == max(same)
        expected.append((i, "response" if whole else "revisit", len(raw), hashlib.sha1(raw).hexdigest(), text if whole else None))
    assert sorted(back, key=key) == sorted(expected, key=key)
    ids = {x.capture.id: x.capture.payload_digest for x in got if x.capture.type == "response"}
    assert all(ids[x.capture.refers_to] == x.capture.payload_digest for x in got if x.capture.type == "revisit")


def test_archives_of_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.captures(warc.read(spark, str(tmp_path / "w"))).collect() == []


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n\x00\xffpage"
    sha = "sha1:" + base64.b32encode(hashlib.sha1(b"\x00\xffpage").digest()).decode()
    rec = lambda head, block: f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    parts = [
        rec("warc-type: warcinfo\r\nWARC-Record-ID: <i>\r\n", b"software: none\r\n"),
        rec(f"WARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Concurrent-To: <q>\r\nWARC-Payload-Digest: {sha}\r\nContent-Type: application/http;msgtype=response\r\n", body),
        rec("WARC-Type: request\r\nWARC-Record-ID: <q>\r\nContent-Type: application/http\r\n", b"GET / HTTP/1.1\r\n\r\n"),
        rec("WARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <r>\r\n", b"k: v\r\n"),
        rec("WARC-Type: request\r\nWARC-Record-ID: <lost>\r\nWARC-Concurrent-To: <gone>\r\n", b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # a member a record
    got = warc.captures(warc.read(spark, str(tmp_path))).collect()
    assert [(x.capture.id, bytes(x.capture.payload), x.capture.intact, [q.id for q in x.requests], [m.id for m in x.metadata]) for x in got] == [("<r>", b"\x00\xffpage", True, ["<q>"], ["<m>"])]
    with pytest.raises(ValueError, match="byte 0 of f"):
        list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", "f"))
    with pytest.raises(ValueError):
        warc._inflated(gzip.compress(b"abc")[:-4])


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids(node), sum(not kids(n) for n in below), saved, H(",".join(map(str, ends)))))
    return out


def trie_rows(spark, convs):
    rows = [(c, k + 1, H(f"{len(role.encode())}:", role, text), len(text.encode())) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv long, pos long, turn_hash string, tokens long"), spark.createDataFrame([(c,) for c in convs], "conv long")


def test_trie_is_the_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST", 3)
    r = random.Random(5)
    convs = {r.randrange(-900, 900): [(r.choice("ua"), r.choice(["", "x", "é"])) for _ in range(r.randrange(6))] for _ in range(60)}
    convs |= {1000 + k: [("u", "same"), ("a", "same")] for k in range(40)} | {2000: [("u", "x")] * 300, 2001: [("u", "x"), ("a", "y")], 2002: [("a", "y"), ("u", "x")]}
    got = prefix_trie.trie(*trie_rows(spark, convs))
    assert {tuple(x) for x in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()} == plain_trie(convs)


def test_trie_of_little(spark):
    assert prefix_trie.trie(*trie_rows(spark, {})).collect() == []
    assert {tuple(x) for x in prefix_trie.trie(*trie_rows(spark, {3: [], 1: []})).select("conv_id", "depth", "n_convs", "n_leaves").collect()} == {(1, 0, 2, 1)}


def test_rebuilt_conversations(spark, tmp_path):
    rows = [(c, t, "u", f"{t}") for c in (0, 1, 2, 5, 7, 11, -4) for t in range(c % 9 + 2)] + [(6, None, None, None), (6, 0, "u", "first"), (6, 0, "u", "first"), (None, 1, "u", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, H(f"{len((role or '').encode())}:", role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rest = lambda c: abs(c) % 5 * (1 if c >= 0 else -1)
    convs = {c: own.get(c - rest(c), [])[: h[c]] + own[c][h[c] :] for c in own}
    got = structure_queries.op13_prefix_trie(spark, str(tmp_path)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {tuple(x) for x in got.collect()} == plain_trie(convs)


def test_secrets_need_no_digit_elsewhere_and_whole_spans_win():
    trees = pii.trained()
    found = lambda text: [(k, text[a:b]) for k, a, b, *_ in pii.find(text, trees)]
    assert found("token: abcdefghQWERTY") == found("token: abcdefghQWERTY x 1")[:1]
    assert found("IBAN DE89 3704 0044 0532 0130 00") == [("account", "DE89 3704 0044 0532 0130 00")]
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    assert ("secret", token) in found(f"auth bearer: {token} end")
    text = "a@b.c" + "x" * 40 + " 1.2.3.4 5.6.7.8 9.9.9.9 8.8.8.8 7.7.7.7 6.6.6.6"
    assert all(pii._free(sorted([(0, 60), (50, 57), (51, 58), (52, 59), (53, 60), (54, 60)]), a, a + 1, 60) == (a >= 60) for a in range(1, 70)) and found(text)[0][0] == "email"


def test_windows_over_words_find_what_texts_hold():
    r = random.Random(8)
    items = [(str(i), " ".join(r.choice(["a", "B", "é", "c1"]) for _ in range(r.randrange(0, 14)))) for i in range(30)] + [("3", "same id other text"), (None, "none"), ("9", None)]
    matcher = decontam.automaton(decontam.windows(items, 4))
    for _ in range(60):
        text = " ".join(r.choice(["a", "b", "É", "é", "C1", "same id", "other, text", "zz"]) for _ in range(r.randrange(40)))
        words = [w.decode() for w in decontam.words_of(text.encode())]
        hit, named = set(), set()
        for name, item in items:
            w = [x.decode() for x in decontam.words_of((item or "").encode())]
            for k in range(max(1, len(w) - 3) if w and name else 0):
                run = w[k : k + 4]
                for at in range(len(words) - len(run) + 1):
                    if words[at : at + len(run)] == run:
                        hit |= set(range(at, at + len(run)))
                        named.add(name)
        n, runs, found = decontam.scan(text.encode(), matcher)
        assert (n, {p for a, b in runs for p in range(a, b)}, found) == (len(words), hit, named)


def test_shards_are_cut_as_a_plain_loop_cuts(spark):
    r = random.Random(3)
    texts = [r.choice(["copy", "x" * 50, "y" * r.randrange(200), None, "é" * r.randrange(30)]) for _ in range(300)]
    df = spark.createDataFrame([(r.choice([None, i]), t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")).collect()
    order = sorted(rows, key=lambda x: (x.h, x.doc_id is not None, x.doc_id or 0, x.c))
    sizes = [len(x.t.encode()) + 8 for x in order]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    total, n = sum(sizes), 7
    cuts = []
    for k in range(1, n):
        cut = total * k // n
        at = max(i for i, s in enumerate(starts) if s <= cut)  # the row that the target falls into, or at whose begin it lies
        group = [i for i, x in enumerate(order) if x.h == order[at].h]
        a, b = starts[group[0]], starts[group[-1]] + sizes[group[-1]]
        if len(group) > 1 and b - a <= sharding.WHOLE * total / n:
            cut = a if cut - a <= b - cut else b
        cuts.append(cut)
    want, slots = [], {}
    for x, s, size in zip(order, starts, sizes):
        shard = sum(s >= c for c in cuts)
        want.append((x.doc_id is not None, x.doc_id or 0, size, x.c, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    got = [(x.id is not None, x.id or 0, x.size, x.text_crc32, x.shard, x.slot) for x in sharding.assign_shards(df, n, partitions=5).collect()]
    assert sorted(got) == sorted(want)
