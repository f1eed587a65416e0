import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from paperloom.functions import names as N
from paperloom.functions import text as T
from paperloom.operators import graph, linkage, messages, retrieval
from paperloom.sources import readers
from paperloom.sources.mailbox import MailboxSource, Pages, planned
from paperloom.streaming import intake, reminders


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text("# Lease\n\n- one\n\nRent is $900.\n\n```x```")
    (tmp_path / "deep/b.csv").write_text('day,who\n2024-01-02,"Ann, B"\n')
    (tmp_path / "c.html").write_text("<h2>Top</h2><script>no</script><p>Text &amp; more</p><ul><li>item</li></ul>")
    (tmp_path / "d.eml").write_bytes(b"Subject: =?utf-8?q?Caf=C3=A9?=\r\nFrom: a@example.org\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello\r\n> quoted\r\n\r\n> a\r\n> b\r\n")
    sheet = '<s><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"><v></v></c></row></s>'
    (tmp_path / "e.xlsx").write_bytes(archive({"xl/sharedStrings.xml": "<x><si><t>name</t></si></x>", "xl/worksheets/sheet1.xml": sheet}))
    slide = "<s><p><t>Title</t></p><p><t>Point</t></p></s>"
    (tmp_path / "f.pptx").write_bytes(archive({"ppt/slides/slide10.xml": slide, "ppt/slides/slide2.xml": slide}))
    (tmp_path / "g.docx").write_bytes(archive({"word/document.xml": '<d xmlns:w="w"><w:p><w:pStyle w:val="Heading2"/><w:t>Head</w:t></w:p><w:p><w:t>Body</w:t></w:p></d>'}))
    (tmp_path / "h.bin").write_bytes(b"?")
    (tmp_path / "i.txt").write_bytes(b"")
    (tmp_path / "j.xlsx").write_bytes(b"PK broken")
    rows = readers.read(spark, str(tmp_path)).collect()
    of = lambda name: [(r.kind, r.depth, r.page, r.text) for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.position)]
    assert of("a.md") == [("title", 0, None, "Lease"), ("listItem", 0, None, "one"), ("text", 0, None, "Rent is $900."), ("code", 0, None, "```x```")]
    assert of("b.csv") == [("table", 0, None, "| day | who |\n| --- | --- |\n| 2024-01-02 | Ann, B |")]
    assert of("c.html") == [("title", 1, None, "Top"), ("text", 0, None, "Text & more"), ("listItem", 0, None, "item")]
    assert of("d.eml") == [("title", 0, None, "Café"), ("text", 0, None, "From: a@example.org"), ("text", 0, None, "Hello")]
    assert of("e.xlsx")[1][3] == "| name |   | 5 |\n| --- | --- | --- |"
    assert [r[2] for r in of("f.pptx")] == [2, 2, 10, 10]
    assert of("g.docx") == [("title", 1, None, "Head"), ("text", 0, None, "Body")]
    assert {r.path[-5:] for r in rows if r.problem} == {"h.bin", ".xlsx"}


def test_tables_of_many_rows(spark, tmp_path):
    """All rows of a table are kept, in blocks below the same heading."""
    lines = ["n,word", *(f"{i},w{i}" for i in range(1, 1203))]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.tsv").write_text("\n".join(x.replace(",", "\t") for x in lines[:501]))
    cells = "".join(f'<row><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 1002))
    (tmp_path / "c.xlsx").write_bytes(archive({"xl/worksheets/sheet1.xml": f"<s>{cells}</s>"}))
    rows = sorted(readers.read(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.position))
    body = lambda name: [r.text.split("\n") for r in rows if r.path.endswith(name) and r.kind == "table"]
    for name, n in (("a.csv", 1203), ("b.tsv", 501)):
        blocks = body(name)
        assert all(b[:2] == ["| n | word |", "| --- | --- |"] for b in blocks)
        assert [x for b in blocks for x in b[2:]] == ["| " + x.replace(",", " | ") + " |" for x in lines[1:n]]
    assert len(body("a.csv")) == 3 and len(body("b.tsv")) == 2
    assert ["| 1 |"] + [x for b in body("c.xlsx") for x in b[2:]] == [f"| {i} |" for i in range(1, 1002)]
    assert [r.kind for r in rows if r.path.endswith("c.xlsx")] == ["title", "table", "table", "table"]


def test_mailbox(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text("\n".join(json.dumps({"cursor": c, "message_id": m, "text": "t"}) for c, m in ((1, "a"), (2, "b"), (3, "a"))))
    spark.dataSource.register(MailboxSource)
    load = lambda s: {(r.cursor, r.message_id) for r in spark.read.format("mailbox").option("path", str(tmp_path)).option("since", s).load().collect()}
    assert load(-1) == {(1, "a"), (2, "b")} and load(2) == {(3, "a")}
    out = tmp_path / "out"
    start = lambda: spark.readStream.format("mailbox").option("path", str(tmp_path)).load().writeStream.foreachBatch(intake.upserts(str(out), ["message_id"], "cursor")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q = start()
    q.processAllAvailable(), q.stop()
    (tmp_path / "2.jsonl").write_text(json.dumps({"cursor": 9, "message_id": "b", "text": "new"}))
    q = start()
    q.processAllAvailable(), q.stop()
    assert {(r.message_id, r.text) for r in intake.current(spark, str(out), ["message_id"]).collect()} == {("a", "t"), ("b", "new")}


def mail(path, *messages):
    path.write_text("\n".join(m if isinstance(m, str) else json.dumps({"cursor": m[0], "message_id": m[1], "text": m[2]}) for m in messages))


def test_mailbox_sync(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    box.mkdir()
    spark.dataSource.register(MailboxSource)
    assert spark.read.format("mailbox").option("path", str(tmp_path / "none")).load().count() == 0

    def sync():
        stream = spark.readStream.format("mailbox").option("path", f"file://{box}").load()
        q = stream.writeStream.foreachBatch(intake.synced(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.cursor, r.message_id, r.text) for r in intake.messages(spark, out).collect()), [tuple(r) for r in intake.reports(spark, out).orderBy("batch").select("cursor", "added", "had", "failed").collect()]

    mail(box / "1.jsonl", (1, "a", "one"), "{damaged", (2, "b", None), (3, "a", "again"))
    mail(box / "2.jsonl", '{"cursor": 4}', (5, "a", "third"), (6, "c", ""))
    assert spark.readStream.format("mailbox").option("path", str(box)).load().schema.names == ["cursor", "message_id", "text", "problem"]
    whole = spark.read.format("mailbox").option("path", str(box)).load()
    assert whole.rdd.getNumPartitions() == 2 and whole.where("problem IS NOT NULL").count() == 2
    first = [(1, "a", "one"), (2, "b", None), (6, "c", "")]
    assert sync() == (first, [(6, 3, 1, 2)])
    # Nothing new: no batch. Then one message behind a damaged one; the cursor goes on.
    assert sync() == (first, [(6, 3, 1, 2)])
    mail(box / "3.jsonl", "[]", (7, "c", "label"), (8, "d", "new"))
    assert sync() == ([*first, (8, "d", "new")], [(6, 3, 1, 2), (8, 1, 1, 1)])
    # The mailbox has forgotten what came after 8: all pages are read, what is known is passed over.
    (box / "1.jsonl").unlink()
    (box / "history.json").write_text('{"oldest": 20}')
    mail(box / "4.jsonl", (20, "e", "late"))
    assert sync() == ([*first, (8, "d", "new"), (20, "e", "late")], [(6, 3, 1, 2), (8, 1, 1, 1), (20, 1, 4, 2)])


def test_mailbox_plan(tmp_path):
    mail(tmp_path / "b.jsonl", *[(i, f"m{i}", "x" * 900) for i in range(10, 110)], "{" * 300_000)
    mail(tmp_path / "a.jsonl", (1, "m", "t"), (9, "n", "t"))
    mail(tmp_path / "junk.jsonl", "?", "!")
    mail(tmp_path / "empty.jsonl")
    pages = Pages(str(tmp_path))
    assert [(p.first, p.last) for p in planned(pages, -1)] == [(1, 9), (10, 109)]
    assert [(p.first, p.last, p.after) for p in planned(pages, 9)] == [(10, 109, 9)] and planned(pages, 109) == []
    assert [p.first for p in planned(pages, 3, 9)] == [1]
    assert [r[0] for r in pages.read(planned(pages, 105)[0])] == [106, 107, 108, 109, 109]


def test_put_off_tasks_return(spark, tmp_path):
    for name, value in reminders.STATE_STORE.items():
        spark.conf.set(name, value)
    schema = "key string, at timestamp, action string, until date, extra int"
    n = 0

    def run(*rows):
        nonlocal n
        n += 1
        df = spark.createDataFrame([(*r, 0) for r in rows], "key string, at string, action string, until string, extra int")
        df.select("key", F.to_timestamp("at").alias("at"), "action", F.to_date("until").alias("until"), "extra").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = reminders.returning(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.key, str(r.day), str(r.decided_at)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    a, b, d, f = ("a", "2024-01-03", "2024-01-01 08:00:00"), ("b", "2024-01-04", "2024-01-02 10:00:00"), ("d", "2024-01-05", "2024-01-01 09:30:00"), ("f", "2024-01-06", "2024-01-05 12:00:00")
    assert run(
        ("a", "2024-01-01 08:00:00", "snooze", "2024-01-03"), ("a", "2024-01-01 08:00:00", "snooze", "2024-01-03"), ("b", "2024-01-01 09:00:00", "snooze", "2024-01-02"),
        ("c", "2024-01-01 09:00:00", "snooze", "2024-01-02"), ("c", "2024-01-01 09:00:00", "undo", None), ("d", "2024-01-01 09:30:00", "snooze", "2024-01-05"), ("e", "2024-01-01 09:00:00", "snooze", None),
        ("g", "2024-01-01 09:00:00", "snooze", "2024-01-01"), ("h", None, "snooze", "2024-01-02"),
    ) == []
    # b is put off again before its day; the clock stands a minute before midnight of a's day.
    assert run(("b", "2024-01-01 23:00:00", "snooze", "2024-01-08"), ("b", "2024-01-02 10:00:00", "snooze", "2024-01-04"), (None, "2024-01-03 00:59:00", None, None)) == []
    assert run((None, "2024-01-03 01:01:00", None, None)) == [a]
    # Each run starts from the checkpoint. A decision older than the latest changes nothing, and none comes back twice.
    assert run((None, "2024-01-04 02:00:00", None, None)) == [a, b]
    assert run(("d", "2024-01-01 08:00:00", "undo", None), ("f", "2024-01-05 12:00:00", "snooze", "2024-01-06")) == [a, b, d]
    assert run(("i", "2024-01-07 12:00:00", "done", None)) == [a, b, d, f]
    assert run((None, "2024-02-07 12:00:00", None, None)) == [a, b, d, f]
    for name in reminders.STATE_STORE:
        spark.conf.unset(name)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 02:00:00")], "text string, t string").select("text", F.to_timestamp("t").alias("added_at"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = intake.added_once(stream).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("once").collect()) == ["x", "y"]
    talk = docs.withColumnRenamed("added_at", "ts").withColumn("speaker", F.lit(1))
    talk.write.parquet(str(tmp_path / "talk"))
    q = intake.grouped(spark.readStream.schema(talk.schema).parquet(str(tmp_path / "talk")), gap="90 minutes").writeStream.format("memory").queryName("groups").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.pieces for r in spark.table("groups").collect()] == [3]


def test_name_ladder(spark):
    cases = [
        ("nora quill", "nora j quill", "subsequence"), ("t osric", "tamsin osric", "initials"), ("albert finc", "albert finch", "typo"), ("jon bale", "jan bale", None),
        ("okonjo", "amara okonjo", "surname"), ("osbert ii", "osbert iii", None), ("benedict corran", "benedict alvers", None), ("catherine smith", "catherina smyth", "similar"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    kind = N.match_kind(F.col("a"), F.col("b"), N.similarity(F.col("a"), F.col("b")), N.distinguishing_similarity(F.col("a"), F.col("b")))
    assert [r.k for r in df.select(kind.alias("k")).collect()] == [c[2] for c in cases]
    assert round(N.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_communities(spark):
    ties = spark.createDataFrame([(1, 2, 10, True), (2, 3, 10, True), (1, 3, 10, True), (7, 8, 5, True)], "a long, b long, weight long, binds boolean")
    labels = {r.record_id: r.label for r in graph.communities(ties).collect()}
    assert labels[1] == labels[2] == labels[3] and labels[7] == labels[8] != labels[1]


def test_merged_names(spark):
    """In rounds, as by the loop over names, longest first."""
    import random

    from paperloom.operators import linkage

    rng = random.Random(7)
    names = [f"{'n' * rng.randint(1, 6)}{i}" for i in range(60)]
    pairs = {tuple(rng.sample(names, 2)) for _ in range(70)}
    near = lambda a, b: (a, b) in pairs or (b, a) in pairs
    order, keeper = sorted(names, key=lambda x: (-len(x), x)), {}
    for a in order:
        if a not in keeper:
            keeper[a] = a
            for b in order[order.index(a) + 1 :]:
                if b not in keeper and near(a, b):
                    keeper[b] = a
    made = linkage.merged(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(list(pairs), "longer string, shorter string"))
    assert {r.name: r.keeper for r in made.collect()} == keeper


def trigrams(s):
    return {("  " + s + " ")[i : i + 3] for i in range(len(s) + 1)}


def test_alike_names_without_a_common_block(spark):
    """Candidates against all pairs, with names that differ in their first letters."""
    rng = random.Random(3)
    base = ["katherine", "sandoval", "jonathan", "elisabeth", "christopher", "montgomery", "abernathy", "extraordinarily long unbroken"]
    spelled = lambda w: (lambda i: w[:i] + rng.choice(["", "x", w[i : i + 1] * 2]) + w[i + 1 :])(rng.randrange(3))
    names = {"katherine", "catherine", "sandoval", "andoval", "counterrevolutionarieswithoutblanks", "xounterrevolutionarieswithoutblanks", "bcdefghijklmnopq rstuvwxyzabcdefghi", "acdefghijklmnopq sstuvwxyzabcdefghi"}
    names |= {" ".join(spelled(w) for w in rng.sample(base, rng.choice([1, 2, 2, 3]))) for _ in range(120)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = [(a, b) for a in names for b in names if a < b]
    dice = {(a, b): 2 * len(trigrams(a) & trigrams(b)) / (len(trigrams(a)) + len(trigrams(b))) for a, b in pairs}
    for least in (0.5, 0.9):
        got = [(r.a, r.b) for r in linkage.alike_pairs(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in pairs if dice[p] >= least}
    assert dice["catherine", "katherine"] >= 0.5 and dice["andoval", "sandoval"] >= 0.5
    same = {(r.longer, r.shorter) for r in linkage.same_thing(linkage.merge_pairs(df)).where("why = 'alike'").collect()}
    assert ("counterrevolutionarieswithoutblanks", "xounterrevolutionarieswithoutblanks") in {tuple(sorted(p)) for p in same}
    whole = spark.createDataFrame(pairs, "a string, b string")
    found, all_pairs = ({tuple(r) for r in linkage.matched(p).collect()} for p in (linkage.ladder_pairs(df), whole))
    assert found == all_pairs
    blocked = {tuple(r) for r in linkage.matched(linkage.name_pairs(df)).collect()}
    assert all_pairs - blocked


def test_whole_texts_count(spark):
    """What comes late in a long text counts: its words, the category that it names, and how readable it is."""
    late = " granite marble basalt"
    filler = lambda w: f"{w} " * 1000
    df = spark.createDataFrame([(1, filler("alpha") + late * 400), (2, filler("bravo") + late * 400), (3, filler("gamma")), (4, filler("delta")), (5, filler("omega"))], "id long, text string")
    assert [(r.a, r.b) for r in graph.alike(df).collect()] == [(1, 2)]
    assert graph.alike(df, considered=4000).count() == 0
    category = retrieval.likely_category(F.col("text"), ["marble", "slate"])
    assert {r.id: r.c for r in df.select("id", category.alias("c")).collect()} == {1: "marble", 2: "marble", 3: None, 4: None, 5: None}
    half = spark.createDataFrame([("a" * 3000 + "\u00e9" * 3000,)], "text string")
    assert half.select(T.readable(F.col("text"))).first()[0] == 0.5


def test_texts_tie_records(spark):
    """Alike texts add to the weight of a pair, and tie records that share no entity."""
    texts = spark.createDataFrame([(1, "granite marble basalt"), (2, "granite marble basalt"), (3, "granite marble quarry"), (4, "meadow quarry"), (5, "meadow orchard"), (6, "orchard")], "id long, text string")
    links = spark.createDataFrame([(1, 10), (2, 10), (4, 11), (6, 11)], "record_id long, entity_id long")
    records = texts.select(F.col("id").alias("record_id"))
    weights = lambda df: {(r.a, r.b): r.weight for r in df.collect()}
    bare, cosine = weights(graph.ties(links, records)), {(r.a, r.b): r.cosine for r in graph.alike(texts).collect()}
    assert bare == {(1, 2): 500, (4, 6): 500} and (1, 3) in cosine and (4, 6) not in cosine
    assert weights(graph.ties(links, records, texts)) == {p: bare.get(p, 0) + int(400 * cosine.get(p, 0)) for p in bare.keys() | cosine.keys()}


def test_utterances_of_bounded_length(spark):
    """Against the loop that defines it: a group ends at a silence, or before it would pass 700 characters."""
    rng = random.Random(8)
    rows, expected = [], set()
    for speaker in range(5):
        at, before, number, pieces = 0, 0, 0, []
        for i in range(150):
            at += rng.choice([0, 1, 1, 2, 2, 2, 2, 2, 9])
            text = rng.choice(["", "  "]) if rng.random() < 0.1 else " " * rng.randrange(2) + "x" * rng.choice([3, 40, 100, 333, 350, 800])
            rows.append((i, speaker, at, text))
            if text := text.strip():
                if pieces and (at - before > 2 or len(" ".join(p for _, p in pieces)) + len(text) > 700):
                    expected.add((speaker, number := number + 1, pieces[0][0], pieces[-1][0], len(pieces), " ".join(p for _, p in pieces)))
                    pieces = []
                pieces.append((at, text))
                before = at
        expected.add((speaker, number + 1, pieces[0][0], pieces[-1][0], len(pieces), " ".join(p for _, p in pieces)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, speaker long, s long, text string").select("id", "speaker", F.timestamp_seconds("s").alias("ts"), "text")
    got = messages.utterances(df, "2").select("speaker", "group", F.unix_seconds("start"), F.unix_seconds("end"), "pieces", "text")
    assert {tuple(r) for r in got.collect()} == expected
