"""Operators against brute force, exact round trips and held-out accuracy, on small tables with every odd row."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import bpe, fingerprints, neardup, packing, queries, substring, suffix, topk, toxicity, urls, warc
from paperloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = say(60), say(200)
    out: list[tuple[int | None, str | None]] = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            out.append((i, say(rng.randint(1, 90))))
        elif kind == 1:
            out.append((i, say(20) + "\n" + passage + "\t" + say(15)))
        elif kind == 2:
            words = base.split()
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = "edit"
            out.append((i, " ".join(words)))
        elif kind == 3:
            out.append((i, base))
        elif kind == 4:
            out.append((i, ("la " * rng.randint(1, 80)).upper() + "ß" * rng.randint(0, 120)))
        else:
            out.append((i, ["", None, "one", "  \n ", "x" * 300, say(3000)][i // 6 % 6]))
    return [*out, (3, base), (9, base), (70, say(40) + "🙂" * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), "clash") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def jaccard_sets(text, words):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words):
    table = [(i, jaccard_sets(t, words)) for i, t in texts()]
    parent = {i: i for i, _ in table}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(table):
        for j, b in table[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    expected = sorted(((i, len(s), find(i), find(i) == i) for i, s in table), key=repr)
    assert rows(neardup.near_duplicates(docs, words=words, percent=80), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_near_duplicates_search_in_blocks(spark, monkeypatch):
    """Chains whose ends are unlike each other, over buckets that are searched block by block."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    words = [f"v{i}" for i in range(400)]
    chain = spark.createDataFrame([(k, " ".join(words[k * 8 : k * 8 + 160])) for k in range(30)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(chain, words=2).collect()} == {0}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (5, None)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window", [35, 3])
def test_word_repeats(docs, window):
    table = [(i, WORD.findall(t or "")) for i, t in texts()]
    count: dict[tuple, int] = {}
    for _, w in table:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] = count.get(tuple(w[k : k + window]), 0) + 1
    expected = []
    for i, w in table:
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        expected.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert rows(substring.remove_repeats(docs, window=window), "doc_id", "n_words", "n_removed", "kept") == sorted(expected, key=repr)


@pytest.mark.parametrize("length", [50, 20])
def test_byte_repeats(docs, length):
    table = [(i, (t or "").encode()) for i, t in texts()]
    least: dict[bytes, int] = {}
    for i, b in table:
        for k in range(len(b) - length + 1):
            least[b[k : k + length]] = min(i, least.get(b[k : k + length], i))
    expected = []
    for i, b in table:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(docs, length=length).collect()), key=repr)
    assert got == sorted(expected, key=repr)


def test_chunks_of_short_texts_only(spark, monkeypatch):
    """Texts that are shorter than a window each, but not together, in all chunks and in all but those of two documents."""
    short = [(i, f"short text {i}") for i in range(40)]
    shared = "one and the same passage of more than fifty bytes, twice"
    for table, removed in ((short, {}), ([*short, (50, "a" + shared), (51, "bc" + shared)], {51: len(shared)})):
        monkeypatch.setattr("paperloom.llm._chunks.CHUNK_BYTES", 100 if removed else 1 << 22)
        got = suffix.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed) for r in got} == {i: (len(t), removed.get(i, 0)) for i, t in table}


def test_top_k_of_large_vectors(spark):
    """All finite vectors take part, however large; a score that 64 bits can't hold is an error, and no wrong number."""
    rng = np.random.default_rng(4)
    data = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(0, 4)).astype(np.float32).tolist()) for i in range(60)]
    data += [(100, [1e9] * 4 + [0.0] * 4), (101, [0.0] * 4 + [1.0] * 4), (102, [2.0**23, -(2.0**23)] + [0.0] * 6), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (105, None)]
    table = lambda rows: topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in data if i < 103}
    score = lambda q, d: sum(x * y for x, y in zip(whole[q], whole[d], strict=True))
    expected = {(q, r, *sorted(((-score(q, d), d) for d in whole if d != q))[r - 1]) for q in whole for r in range(1, 6)}
    got = topk.top_k(table(data), table(data), cells=4).collect()
    assert {(r.query_id, r.rank, -r.score, r.vec_id) for r in got} == expected and len(got) == 5 * len(whole)
    assert max(score(q, q) for q in whole) > 2**63
    huge = table([(1, [1e9] * 8), (2, [1e9] * 8), (3, [-1e9] * 8)])
    for rows in (huge, table([(1, [1e30]), (2, [1.0])])):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(rows, rows, k=1).collect()


def test_hot_windows_travel_alone(docs, monkeypatch):
    """The result is the same when every minimiser counts as hot."""
    plain = rows(substring.remove_repeats(docs, window=5), "doc_id", "n_removed", "kept"), rows(suffix.remove_repeats(docs), "doc_id", "n_removed", "n_spans")
    for module in (substring, suffix):
        monkeypatch.setattr(module, "HOT_SAMPLE", 1)
        monkeypatch.setattr(module, "HOT_LEAST", 2)
    assert (rows(substring.remove_repeats(docs, window=5), "doc_id", "n_removed", "kept"), rows(suffix.remove_repeats(docs), "doc_id", "n_removed", "n_spans")) == plain


def test_maximal_groups_are_maximal():
    """Each group is the longest common extension of its members, and has all of them."""
    strings = [b"abcdeXYZabcdef", b"QQabcdeXYZab", b"zzabcdezz"]
    data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    string, place, size, smallest = suffix.maximal_groups(data, offsets, np.array([3, 1, 2]), np.zeros(3, bool), 4)
    found = {(strings[s][p : p + z], int(d)) for s, p, z, d in zip(string, place, size, smallest, strict=True)}
    assert (b"abcdeXYZab", 1) in found and (b"abcde", 1) in found


def test_whole_characters(spark):
    a = "é" * 60 + "end"
    df = spark.createDataFrame([(1, "x" + a), (2, "yy" + a), (3, "y\u00c3" + a)], "doc_id long, text string")
    for r in suffix.remove_repeats(df, whole_characters=True, keep=[]).collect():
        bytes(r.kept).decode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_round_trip(spark, docs, name):
    from tokenizers import Tokenizer

    path = bpe.named(name)
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    odd = ["".join(rng.choice(["a", "Z", "é", "Σ", "İ", "ß", " ", "\n", "'s", "1", "!?", "<|endoftext|>", "漢", "🙂", "\x1c", "\x00", "\x01", "qz"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def check_packing(got, table, path, capacity=2048):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    pending = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in table)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert total == sum(map(len, pending)) == sum(r.length for r in got)
    return padding / max(1, total)


def test_packing(docs):
    path = bpe.named("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    assert check_packing(got, texts(), path) < 0.05
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    unique = {i: t for i, t in texts() if sum(j == i for j, _ in texts()) == 1}
    for i, t in unique.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_patterns_cover_the_demand():
    rng = random.Random(3)
    for _ in range(20):
        demand = {s: rng.randint(1, 500) for s in rng.sample(range(1, 129), rng.randint(1, 40))}
        made = packing.patterns(demand, 128)
        for s, n in demand.items():
            assert sum(p.get(s, 0) * t for p, t in made) == n
        assert all(sum(s * c for s, c in p.items()) <= 128 for p, _ in made)
        sizes = np.array(sorted(demand))
        need = np.array([demand[s] for s in sizes], float)
        _, _, duals = packing.relaxed(sizes, need, 128)
        # Weak duality: duals that no pattern exceeds bound every cover from below.
        duals = np.maximum(duals, 0)
        bound = duals @ need / max(1.0, packing.price(duals, sizes, 128)[0])
        assert bound - 1e-6 <= sum(t for _, t in made) <= bound + len(demand)


@pytest.mark.parametrize("task_rows", [topk.TASK_ROWS, 3])
def test_top_k(spark, monkeypatch, task_rows):
    monkeypatch.setattr(topk, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vectors = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.2]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)] + [(7, vectors[7][1])]
    odd = [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [1.0] * 7 + [float("nan")]), (2003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    table = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    expected = []
    for q in (i for i in table if i % 50 == 0):
        best = sorted((-int(table[q] @ v), i) for i, v in table.items() if i != q)[:5]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    data = topk.scaled(df, "vec_id", "embedding")
    assert rows(topk.top_k(data.where("id % 50 = 0"), data, cells=8), "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)
    few = data.where("id < 3")
    assert topk.top_k(few, few).count() == 6
    assert topk.top_k(data.limit(0), data).count() == 0 == topk.top_k(data, data.limit(0)).count()


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, None, None), (3, "http://a/3\r\nX: y", ""), (4, "http://a/4", "<p>x</p>"), (5, "http://a/5", "é" * 200_000), (None, "http://a/6", "<p>x</p>"), (4, "http://a/4", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    largest: dict = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in pages:
        other = i != largest[h or ""]
        data = (h or "").encode()
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", largest[h or ""] if other else None, True))
    back = warc.read(warc.write(warc.assigned(df)))
    assert rows(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified") == sorted(expected, key=repr)
    assert {bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()} == {h or "" for _, _, h in pages}
    apart = warc.read(warc.write(warc.assigned(df, least_bytes=100)))
    assert apart.where("record_type = 'revisit'").count() == 0
    assert warc.read(warc.write(warc.assigned(df.limit(0)))).count() == 0


def test_damaged_archive():
    import io

    whole = warc.member({"WARC-Type": "response"}, b"abc")
    assert [b for _, b in warc.records(io.BytesIO(whole * 3))] == [b"abc"] * 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-9])))


def brute_sketch(text):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    w = WORD.findall(text or "")
    if not w:
        return []

    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return signed(seed)

    h = [chain(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [chain([" ".join(w)])]
    return sorted({x for x in h if x < -(1 << 63) + (1 << 61)}) or [min(h)]


def test_fingerprints(spark, docs):
    got = docs.select("text", fingerprints.sketch(F.col("text")).alias("s")).collect()
    assert all(r.s == brute_sketch(r.text) for r in got)
    low = [-(1 << 63) + k for k in (1, 2, 3, 4)]
    a, b = F.array(*map(F.lit, low)), F.array(*map(F.lit, low[2:]))
    r = spark.range(1).select(fingerprints.jaccard(a, b).alias("j"), fingerprints.containment(b, a).alias("c"), fingerprints.merged(F.array(a, b)).alias("m")).first()
    assert (r.j, r.c, r.m) == (0.5, 1.0, low)


def test_next_document(spark, docs, empty):
    table = sorted(((i, t or "") for i, t in texts()), key=lambda r: (r[0], r[1]))
    expected = sorted((i, t, table[(k + 1) % len(table)][1]) for k, (i, t) in enumerate(table))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprints.with_next(source, "doc_id", "text", {"n": F.length("text")})
    assert sorted((r.doc_id, r.text, r.next_text) for r in got.collect()) == expected
    one = fingerprints.with_next(source.where("doc_id = 70"), "doc_id", "text", {}).first()
    assert one.text == one.next_text
    assert fingerprints.with_next(empty.select("doc_id", "text"), "doc_id", "text", {}).count() == 0
    nulls = spark.createDataFrame([(None, "n"), (5, "a"), (-2, "b")], "doc_id long, text string")
    assert {(r.text, r.next_text) for r in fingerprints.with_next(nulls, "doc_id", "text", {}).collect()} == {("n", "b"), ("b", "a"), ("a", "n")}


def test_urls(spark):
    cases = [
        ("http://Sub.Example.ORG/es/x?q", "sub.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/17#t", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://a.org", "a.org", "", None, "allow"), ("http://a.org/", "a.org", "/", "org/", "allow"), ("x://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"), ("x://b.com/de/", "b.com", "/de/", "com/de/", "block"),
        ("http://notcom/fr/", "notcom", "/fr/", None, None), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?a", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, host string")
    for r in urls.judge(df).collect():
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    held = {"http://cheap-pills.example/now": "block", "http://free-bets-casino.example/bonus": "block", "http://news.city.example/world": "allow", "http://wiki.garden.example/en/soil": "allow"}
    got = urls.judge(spark.createDataFrame([(u,) for u in held], "url string")).collect()
    assert {r.url: r.verdict for r in got} == held
    assert urls.judge(df.limit(0)).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(6)
    clean, toxic = [f"word{i}" for i in range(200)], ["scoundrel", "fiend", "wretch"]

    def document(bad):
        sentences = [" ".join(rng.choices(clean, k=8)) for _ in range(rng.randint(1, 12))]
        at = rng.randrange(len(sentences))
        if bad:
            sentences[at] += " " + rng.choice(toxic)
        return ". ".join(sentences) + ".", at

    made = [(i, *document(i % 5 == 0), i % 5 == 0) for i in range(900)]
    df = spark.createDataFrame([(i, t, at, float(y)) for i, t, at, y in made], "doc_id long, text string, at int, label double")
    model = toxicity.fit(df.where("doc_id % 3 > 0"))
    held = toxicity.score(df.where("doc_id % 3 = 0"), model).collect()
    assert sum((r.score >= 0.3) == bool(r.label) for r in held) / len(held) > 0.97
    located = [r for r in held if r.label and r.score >= 0.3]
    assert all(any(w in r.text[r.worst_start : r.worst_end] for w in toxic) for r in located)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "...", "x"), (4, "word1 " * 20_000, "x"), (4, "é", "x")], "doc_id long, text string, score string")
    assert [r.score for r in toxicity.score(odd, model).orderBy("doc_id").collect()][:3] == [0.0, 0.0, 0.0]
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(df.limit(0))).agg(F.max("score")).first()[0] < 1e-9


def test_empty_tables(empty):
    path = bpe.named("byte_bpe_50k.json")
    assert neardup.near_duplicates(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert packing.pack(empty, path).count() == 0
    assert bpe.encode(empty, path).count() == 0


def plain_score(text, model):
    """Noisy-or over sentences, word by word."""
    from paperloom.llm._arrow import prefix_hash, span_hash

    def bucket(word, i):
        data = np.frombuffer(word, np.uint8)
        return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0] ^ np.uint64(i)) & ((1 << toxicity.BITS) - 1)

    clean = 1.0
    for sentence in re.split(rb"(?<=[\n!.?])", (text or "").encode()):
        words = re.findall(rb"[a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), sentence))
        if words:
            features = {bucket(w, 0) for w in words} | {bucket(w[:n], i) for i, n in enumerate(toxicity.STEMS, 1) for w in words if len(w) > n}
            clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(float(model.weights[f]) for f in features)))))
    return 1 - clean


def test_pipeline(spark, tmp_path):
    """Each stage on its own input, against brute force: a trained model scored word by word, links on full sets, strings of
    50 bytes, and pieces that make up each document's tokens."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary, bad = [f"term{i}" for i in range(300)], ["scoundrel", "fiend"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, made = say(60), []
    for i in range(240):
        text = say(rng.randint(20, 120)) + ". " + say(12) + "."
        if i % 5 == 0:
            text += f" {say(4)} {rng.choice(bad)} {say(4)}."
        elif i % 7 == 0:
            text += " " + passage
        made.append((i, text))
    made += [(300 + i, made[i][1]) for i in range(20)] + [(330 + i, made[i][1] + " tail") for i in range(20)] + [(400, None), (401, ""), (402, "é" * 90), (403, "one"), (1, made[1][1])]
    table = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(any(w in (t or "") for w in bad))) for i, t in made[:200]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = toxicity.fit(toxicity.sample(source, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    kept = corpus_pipeline.clean(spark, source, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, t in made if plain_score(t, model) < corpus_pipeline.TOXIC)
    left = {r.doc_id for r in kept}
    assert not left & {i for i in range(240) if i % 5 == 0} and left >= {i for i in range(240) if i % 5}

    distinct = corpus_pipeline.distinct(spark, source, str(tmp_path))
    sets = [(i, jaccard_sets(t, 5)) for i, t in made]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(i for i, _ in made if find(i) == i)

    whole = corpus_pipeline.unrepeated(spark, source, str(tmp_path))
    assert whole.columns == corpus_pipeline.COLUMNS
    least: dict[bytes, int] = {}
    for i, t in made:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            least[data[k : k + 50]] = min(i, least.get(data[k : k + 50], i))
    expected = []
    for i, t in made:
        data, gone = (t or "").encode(), set()
        for k in range(len(data) - 49):
            if least[data[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        at, out = 0, ""
        for c in t or "":
            size = len(c.encode())
            out += "" if all(x in gone for x in range(at, at + size)) else c
            at += size
        expected.append((i, out, "en", "src", len(out)))
    assert rows(whole, *corpus_pipeline.COLUMNS) == sorted(expected, key=repr)

    library = Tokenizer.from_file(bpe.named("byte_bpe_50k.json"))
    pieces: dict[int, list] = {}
    for r in corpus_pipeline.packed(spark, source.where("doc_id <> 1"), str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, t in made:
        if i != 1:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            assert sorted(pieces[i])[0][0] == 0 and sum(n for _, n, _ in pieces[i]) == len(ids)
            assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in pieces[i])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "packing"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= left & {i for i, _ in made if find(i) == i}

    (tmp_path / "none").mkdir()
    source.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_scores_and_the_bound_of_the_sample(spark):
    rng = random.Random(7)
    made = [(i, " ".join(rng.choices(["Able", "baker's", "Çedille", "delta", "fiend"], k=rng.randint(1, 30))).replace("delta", "delta. ")) for i in range(300)]
    df = spark.createDataFrame([(i, t, int("fiend" in t and i % 2)) for i, t in made], "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.fit(toxicity.sample(df, labels))
    for r in toxicity.score(df, model).collect():
        assert abs(r.score - plain_score(r.text, model)) < 1e-9
    twice = df.union(df)
    assert toxicity.sample(twice, labels).count() == toxicity.sample(df, labels).count() < 300
    few = toxicity.sample(df, labels, limit=2_000).collect()
    assert 0 < sum(len(r.text.encode()) for r in few) <= 2_000 and toxicity.sample(df, labels, rows=7).count() == 7


def test_fingerprint_query(spark, docs, tmp_path):
    """All columns of the query, by a second implementation of the hash."""
    source = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).cache()
    source.write.parquet(str(tmp_path / "documents.parquet"))
    table = [(r.doc_id, r.text or "") for r in source.orderBy("doc_id").collect()]

    def likeness(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    expected = []
    for k, (i, t) in enumerate(table):
        after = table[(k + 1) % len(table)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        own, other = brute_sketch(t), brute_sketch(edited)
        text = lambda s: ",".join(f"{x & (1 << 64) - 1:X}" for x in s)
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(other), likeness(own, other), likeness(own, brute_sketch(after))))
    got = queries.op3_fingerprints(spark, str(tmp_path))
    assert rows(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(expected, key=repr)


def test_sketch_of_a_union(spark, docs):
    """A hash above the threshold stands for a text only where no other is below."""
    one = [t for _, t in texts() if t and len(brute_sketch(t)) == 1 and brute_sketch(t)[0] >= -(1 << 63) + (1 << 61)]
    many = next(t for _, t in texts() if t and len(brute_sketch(t)) > 3)
    df = spark.createDataFrame([(one[0], many), (one[0], one[-1]), (many, many), ("", one[0])], "a string, b string")
    for r in df.select("a", "b", fingerprints.merged(F.array(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("m")).collect():
        whole = sorted({*brute_sketch(r.a), *brute_sketch(r.b)})
        assert r.m == ([x for x in whole if x < -(1 << 63) + (1 << 61)] or whole[:1])


def test_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rng = random.Random(3)
    table = [(rng.choice([None, 5, *range(-400, 400)]), f"t{k % 90}") for k in range(300)]
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = sorted(((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)), key=repr)
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("part", F.lit("clash"))
    assert rows(fingerprints.with_next(df, "doc_id", "text", {}), "doc_id", "text", "next_text") == expected


def test_cells_that_bounds_rule_out(spark):
    """On clusters most cells are not needed, the result is exact, and shorter vectors count as filled up with zeros."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 4
    points = np.concatenate([c + rng.normal(size=(60, 16)) * 0.05 for c in centres])
    near = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
    radius = np.array([np.sqrt(((points[near == j] - centres[j]) ** 2).sum(1)).max() for j in range(12)])
    floor = np.array([np.sort((points[near == j] @ points[near == j].T), 1)[:, -6].min() for j in range(12)])
    needs = topk.needed(centres, radius, radius, floor)
    scores = points @ points.T
    for i in range(12):
        for j in np.flatnonzero(~needs[i]):
            assert scores[np.ix_(near == i, near == j)].max() < floor[i]
    assert needs.sum() < 12 * 12 / 3
    table = {i: [float(x) for x in p] for i, p in enumerate(points)} | {9000: [3.0], 9050: []}
    df = topk.scaled(spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    whole = {i: np.array([math.floor(256 * x) for x in v] + [0] * (16 - len(v))) for i, v in table.items()}
    expected = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert rows(topk.top_k(df.where("id % 50 = 0"), df, cells=12), "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


def test_foreign_archive_and_false_revisit(spark, tmp_path):
    import io

    info = warc.member({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n\r\n")
    http = b"HTTP/1.1 200 OK\r\n\r\n\x1f\x8bbody\r\n\r\n"
    other = warc.member({"WARC-Type": "response", "Content-Type": "application/http;msgtype=response", "WARC-Block-Digest": "md5:abc"}, http)
    (tmp_path / "a.warc.gz").write_bytes(info + other)
    got = warc.read(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 1)], "path string, extra int")).collect()
    assert [(r.record_type, bytes(r.payload), r.verified) for r in got] == [("warcinfo", b"software: x\r\n\r\n", None), ("response", b"\x1f\x8bbody\r\n\r\n", None)]
    for wrong in (b"abc" + b"\r\n", b""):
        import zlib as z

        press = z.compressobj(4, z.DEFLATED, 31)
        data = press.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\n" + wrong) + press.flush()
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(data)))
    rows_of = [(1, "response", None, "D", 4, b"abcd", True), (2, "revisit", 1, "D", 4, None, True), (3, "revisit", 1, "D", 5, None, True), (4, "revisit", 9, "D", 4, None, True), (1, "response", None, "D", 4, b"abcd", True)]
    df = spark.createDataFrame(rows_of, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, verified boolean")
    assert rows(warc.checked(df), "page_id", "verified") == sorted([(1, True), (1, True), (2, True), (3, False), (4, False)], key=repr)


def test_archives_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)
    df = spark.createDataFrame([(i, f"http://a/{i}", "x" * i) for i in range(20)], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write(warc.assigned(df).coalesce(1))
    assert manifest.count() > 1 and sorted(r.page_id for r in warc.read(manifest).collect()) == list(range(20))


def test_strings_across_batches(spark, docs, monkeypatch):
    """Strings that end one batch and begin the next, tables of few bytes, and windows dealt to several passes."""
    plain = rows(substring.remove_repeats(docs, window=5), "doc_id", "n_removed", "kept"), rows(suffix.remove_repeats(docs), "doc_id", "n_removed", "n_spans", "kept")
    monkeypatch.setattr(substring, "TABLE_BYTES", 300)
    monkeypatch.setattr(suffix, "TABLE_BYTES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = rows(substring.remove_repeats(docs, window=5), "doc_id", "n_removed", "kept"), rows(suffix.remove_repeats(docs), "doc_id", "n_removed", "n_spans", "kept")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain


def test_long_and_odd_urls(spark):
    df = spark.createDataFrame([(1, "http://host/" + "a/ü🙂" * 40_000), (2, "http://" + "h" * 90_000), (2, "http://x"), (3, "http://\n/a")], "page_id long, url string")
    bias, weights = urls.train()
    for r in urls.judge(df).collect():
        u = r.host + r.path
        z = bias + sum(weights[sum(f * ord(c) for f, c in zip(urls.FACTORS, u[i : i + 3], strict=True)) % urls.BUCKETS] for i in range(len(u) - 2))
        assert abs(r.log_odds - z / urls.SCALE) < 1e-9


def test_bpe_of_marks_and_new_code_points(spark):
    from tokenizers import Tokenizer

    path = bpe.named("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["a\x00b c", "\x01", "x\x01y\x00\x00 end", "before \U0003fffe after the word", "\u0378 one two\u0378 three", "don't\x00stop it's", "é\x00É ß", None, "", "a\x00b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in bpe.encode(df, path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    expected = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_topk": "query_id rank vec_id score", "op3_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op4_warc": "page_id payload_bytes payload_digest record_type refers_to", "op9_urls": "page_id host path rule verdict",
    }
    for name, columns in expected.items():
        assert set(columns.split()) <= set(queries.queries()[name](spark, sf).columns)
