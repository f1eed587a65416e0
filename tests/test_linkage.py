"""Names, records and findings against plain loops, with nulls, empty values, ties and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import names as N
from paperloom.operators import agenda, graph, linkage, messages


def test_who_is_meant(spark):
    """A bare surname and disagreeing initials never decide; context, identifiers and rarity may."""
    people = ["amara okonjo", "george h w bush", "joanna ramirez", "j chen", "kian j feiz", "mary major"]
    entities = spark.createDataFrame([(i, n, "person") for i, n in enumerate(people, 1)] + [(50, "acme", "org"), (51, "acme", "place")], "entity_id long, name string, kind string")
    said = [
        (1, 1, "okonjo", "person"), (2, 1, "george w bush", "person"), (3, 2, "j ramirez", "person"), (4, 2, "jane chen", "person"), (5, 3, "kian feiz", "person"), (6, 3, "acme", "person"),
        (7, 4, "okonjo", "person"), (8, 4, "mary major", "person"), (9, 5, "someone else", "person"), (10, 6, "", "person"), (11, 6, None, "person"), (12, 7, "okonjo", "org"), (13, 8, "mary jane major ii", "person"),
    ]
    mentions = spark.createDataFrame(said, "mention_id long, document_id long, name string, kind string")
    got = {r.mention_id: (r.entity_id, r.resolved_by) for r in linkage.resolved(mentions, entities).collect()}
    none = (None, None)
    assert got == {1: none, 2: none, 3: (3, "unambiguous"), 4: none, 5: (5, "unambiguous"), 6: (50, "exact"), 7: none, 8: (6, "exact"), 9: none, 10: none, 11: none, 12: none, 13: (6, "unambiguous")}
    owned = spark.createDataFrame([(4, "email:x"), (4, "email:x"), (1, "email:y"), (2, "email:y")], "entity_id long, identifier string")
    seen = spark.createDataFrame([(2, "email:x"), (1, "email:y")], "document_id long, identifier string")
    context = spark.createDataFrame([(1, 6), (1, 6), (2, 3)], "entity_id long, other_id long")
    got = {r.mention_id: (r.entity_id, r.resolved_by) for r in linkage.resolved(mentions, entities, (owned, seen), context).collect()}
    assert got[3] == (4, "identifier") and got[4] == (4, "identifier") and got[7] == (1, "context") and got[1] == none and got[2] == none
    assert linkage.resolved(mentions.limit(0), entities).count() == 0
    assert {r.entity_id for r in linkage.resolved(mentions, entities.limit(0)).collect()} == {None}


def test_weak_likeness_needs_a_rare_surname(spark):
    names = [f"first{i} surname{i}" for i in range(11)] + ["peter quill"]
    entities = spark.createDataFrame([(i, n, "person") for i, n in enumerate(names)], "entity_id long, name string, kind string")
    mentions = spark.createDataFrame([(1, 1, "peter quil", "person"), (2, 1, "bob quill", "person")], "mention_id long, document_id long, name string, kind string")
    table = F.create_map(F.lit("bob"), F.array(F.lit("peter"), F.lit("robert")))
    assert {r.mention_id: r.resolved_by for r in linkage.resolved(mentions, entities, nicknames=table).collect()} == {1: "unambiguous", 2: "unambiguous"}
    assert {r.entity_id for r in linkage.resolved(mentions, entities.where("entity_id > 0"), nicknames=table).collect()} == {None}
    crowd = entities.union(spark.createDataFrame([(100 + i, f"other{i} quill", "person") for i in range(3)], "entity_id long, name string, kind string"))
    assert {r.mention_id: r.entity_id for r in linkage.resolved(mentions, crowd, nicknames=table).collect()} == {1: 11, 2: None}


def test_no_pair_of_the_ladder_is_lost(spark):
    """Blocking against all pairs, over varied spellings."""
    rng = random.Random(2)
    given, family = ["kristina", "katherine", "jon", "mohammad", "li", "anne", "sean"], ["jonsen", "johnson", "smith", "nguyen", "okafor", "vi"]
    made = {"kristina jonsen", "cristina johnsen", "catherine", "katherine", "sean ii", "sean iii"}
    for _ in range(90):
        name = f"{rng.choice(given)} {rng.choice(['', 'j ', 'mary '])}{rng.choice(family)}"
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(name))
            name = rng.choice([name[:k] + rng.choice("abcdes") + name[k + 1 :], name[:k] + name[k + 1 :], name[:k] + rng.choice("hkc") + name[k:]])
        made.add(" ".join(name.split()))
    names = spark.createDataFrame([(n,) for n in made], "name string")
    a, b = names.select(F.col("name").alias("a")), names.select(F.col("name").alias("b"))
    every = linkage.matched(a.join(b, F.col("a") < F.col("b")))
    found = linkage.matched(linkage.ladder_pairs(names))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in every.collect()}
    assert ("cristina johnsen", "kristina jonsen", "similar") in {tuple(r) for r in found.collect()}


def walked(names):
    taken, out = set(), []
    for id, name in sorted(names):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (name, "")
        new, k = name, 2
        while new.lower() in taken:
            new, k = f"{stem} ({k}){ext}", k + 1
        taken.add(new.lower())
        out.append((id, new))
    return sorted(out)


def test_unique_names(spark):
    rng = random.Random(8)
    names = [(1, "a.txt"), (2, "a.txt"), (3, "a (2).txt"), (4, "untitled"), (5, "A.TXT")]
    names += [(10 + i, rng.choice(["b.md", "B.md", "b (3).md", "b (2) (2).md", "b (2).md", "c", "c (2)", "d.e.f", "plain.pdf"])) for i in range(200)]
    df = spark.createDataFrame([*names, (None, "x"), (900, None)], "id long, name string")
    got = sorted((r.id, r.unique_name) for r in agenda.unique_names(df).collect())
    assert got == walked(names) and len({n.lower() for _, n in got}) == len(names)
    assert agenda.unique_names(df.limit(0)).count() == 0
    drafts = messages.drafts(spark.createDataFrame([(1, "Subject: hi"), (2, "hi"), (3, " \n hi (2)\nx"), (4, ""), (5, None)], "id long, text string"))
    assert sorted((r.id, r.file) for r in drafts.collect()) == [(1, "hi.md"), (2, "hi (2).md"), (3, "hi (2) (2).md"), (4, "untitled.md"), (5, "untitled (2).md")]


def test_stable_hash(spark):
    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits

    texts = ["", "a", "foobar", "Ünïcode — 5", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.stable_hash(F.col("t")).alias("h"))
    assert all(r.h == plain(r.t) for r in df.collect())


def test_findings(spark):
    rows = [
        (1, 1, "  Total 12.50 should be 3 ", "other"), (1, 2, "12.5 and 3 adds up", None), (1, 3, "bad", "impossible_date"), (1, 4, "bad", "impossible_date"), (1, 5, "Nothing to say here", "Unit Mismatch"), (1, 6, None, None), (2, 1, "a = 5 but 5 = 5", None),
    ]
    df = spark.createDataFrame(rows, "document_id long, position long, detail string, label string")
    got = sorted((r.document_id, r.place, r.kind, r.detail) for r in agenda.vetted(df).collect())
    assert got == [(1, 1, "impossibleDate", "bad"), (1, 2, "impossibleDate", "bad"), (1, 3, "arithmetic", "Total 12.50 should be 3"), (1, 4, "inconsistentFormat", "Nothing to say here")]
    assert agenda.vetted(df.drop("label")).count() == 2
    top = agenda.flagged(df.where("detail IS NOT NULL"), limit=1).collect()
    assert [(r.document_id, r.findings) for r in top] == [(1, 5)]


@pytest.mark.parametrize("seed, waves", [(1, True), (2, False), (3, False)])
def test_communities_as_a_loop(spark, monkeypatch, seed, waves):
    rng = random.Random(seed)
    ties = {}
    for _ in range(50 if waves else 160):
        a, b = sorted(rng.sample(range(24 if waves else 70), 2))
        ties[a, b] = (rng.randint(1, 4), rng.random() < 0.7)
    near = {}
    for (a, b), (w, binds) in ties.items():
        near.setdefault(a, []).append((b, w, binds)), near.setdefault(b, []).append((a, w, binds))
    labels = {a: a for a in near}
    for _ in range(20):
        before = dict(labels)
        for a in sorted(near):
            weight = {}
            for b, w, _ in near[a]:
                weight[labels[b]] = weight.get(labels[b], 0) + w
            best = max(weight, key=lambda x: (weight[x], -x))
            if any(labels[b] == best and binds for b, _, binds in near[a]):
                labels[a] = best
        if labels == before:
            break
    rows = [(a, b, w, x) for (a, b), (w, x) in ties.items()]
    df = spark.createDataFrame([*rows, (1, 1, 9, True), (1, None, 9, True), (1, 2, None, True)], "a long, b long, weight long, binds boolean")
    assert {r.record_id: r.label for r in graph.communities(df).collect()} == labels
    if waves:
        monkeypatch.setattr(graph, "TASK_TIES", 20)
        assert {r.record_id: r.label for r in graph.communities(df).collect()} == labels
        assert graph.communities(df.limit(0)).count() == 0


def test_names_of_groups(spark):
    rows = [(1, "Tax", "form")] * 3 + [(2, "Tax", "policy")] * 3 + [(2, "Tax", None)] + [(3, "Home", "lease"), (3, None, "lease"), (3, "Car", " ")] + [(4, "Pets", "note")] * 2 + [(5, "Everything else", None), (5, "Odd", "a"), (5, "", "b")] + [(6, "Forms", "x")] * 3
    df = spark.createDataFrame(rows, "group_id long, value string, kind string")
    assert {r.group_id: r.category for r in graph.voted(df).collect()} == {1: "Forms", 2: "Tax", 3: "Leases", 4: "Everything else", 5: "Everything else", 6: "Xes"}
    assert graph.voted(df.limit(0)).count() == 0


def test_settling(spark):
    fields = [("a", r, f) for r in range(4) for f in ("x", "y")] + [("a", 9, "odd"), ("a", 9, "other")]
    df = spark.createDataFrame(fields, "category string, record_id long, field string")
    read = lambda bad: bad.select("category", "record_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("field"))
    out, passes = graph.settled(df, read)
    assert [p[0] for p in passes] == [1] and passes[0][2] > passes[0][1] and out.where("field = 'odd'").count() == 0
    same, passes = graph.settled(df, lambda bad: df.join(bad.select("record_id"), "record_id", "left_semi"))
    assert len(passes) == 1 and same.count() == df.count()
    assert graph.settled(df.limit(0), read)[1] == []


def test_alike_texts_lose_no_pair(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{'abcdefghij'[i // 26]}rd" for i in range(120)]
    table = [(i, " ".join(rng.choices(words, weights=range(120, 0, -1), k=rng.randint(5, 60)))) for i in range(70)] + [(70, None), (71, ""), (72, "solitary")]
    import math

    counts = {i: {} for i, _ in table}
    for i, t in table:
        for w in (t or "").split():
            counts[i][w] = counts[i].get(w, 0) + 1
    df = {}
    for c in counts.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    n = len(table)
    vectors = {i: {w: k * math.log(n / df[w]) for w, k in c.items() if df[w] > 1 and df[w] / n <= 0.5} for i, c in counts.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    expected = {(i, j): sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / norm[i] / norm[j] for i in vectors for j in vectors if i < j and norm[i] and norm[j]}
    got = {(r.a, r.b): r.cosine for r in graph.alike(spark.createDataFrame(table, "id long, text string")).collect()}
    assert set(got) == {k for k, c in expected.items() if c >= 0.14} and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_initials(spark):
    row = spark.range(1).select(N.initials_disagree(F.lit("george w bush"), F.lit("george h w bush")).alias("x"), N.is_abbreviated(F.lit("j chen")).alias("y"), N.initials_disagree(F.lit("kian feiz"), F.lit("kian j feiz")).alias("z")).first()
    assert (row.x, row.y, row.z) == (True, True, False)


def test_facts_are_admitted(spark):
    texts = spark.createDataFrame([(1, "Joanna Ramirez works at Acme Corp. Her mail is JO@acme.example, she is a Welder."), (2, None)], "document_id long, text string")
    known = spark.createDataFrame([(1, "joanna ramirez", 5), (1, "joanna ramirez", 9), (1, "acme", 6), (2, "acme", 6)], "document_id long, name string, entity_id long")
    cases = [
        (("Joanna Ramirez", " Works_At", "Acme Corp."), (5, 6, None, None)), (("joanna ramirez", "email", "JO@ACME.example"), (5, None, "jo@acme.example", None)), (("Joanna Ramirez", "role", " Welder "), (5, None, "Welder", None)),
        (("Nobody", "role", "Welder"), (None, None, None, "unknown subject")), ((None, "role", "Welder"), (None, None, None, "unknown subject")), (("Acme", "likes", "Welder"), (None, None, None, "unknown predicate")), (("Acme", None, "Welder"), (None, None, None, "unknown predicate")),
        (("Acme", "role", None), (None, None, None, "object length")), (("Acme", "role", "x" * 121), (None, None, None, "object length")), (("Acme", "role", "Painter"), (None, None, None, "not in the document")),
        (("Acme", "owns", "Welder"), (None, None, None, "unknown object")), (("Acme", "owns", "ACME"), (None, None, None, "itself")),
    ]
    df = spark.createDataFrame([(1, *c, "extra") for c, _ in [*cases, cases[0]]] + [(2, "acme", "role", "x", ""), (3, "acme", "role", "x", "")], "document_id long, subject string, predicate string, object string, text string")
    out = agenda.admitted(df, texts, known)
    assert out.columns == ["document_id", "subject", "predicate", "object", "subject_id", "object_id", "object_value", "refused"]
    got = sorted(((r.subject_id, r.object_id, r.object_value, r.refused) for r in out.collect()), key=repr)
    assert got == sorted([e for _, e in [*cases, cases[0]]] + [(None, None, None, "not in the document"), (None, None, None, "unknown subject")], key=repr)
    assert agenda.admitted(df.limit(0), texts, known).count() == 0
