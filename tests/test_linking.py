import bz2
import gzip
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.normalize import normalize_spans, register
from corpuscle.operators import checks, dictionary, matching
from corpuscle.sources import dumps, tables
from corpuscle.streaming import sessions


def test_parse_tuples():
    assert list(dumps.parse_tuples(r"(1,0,'A_B'),(2,0,'Tom\'s'),(3,NULL,'x\ny')")) == [["1", "0", "A_B"], ["2", "0", "Tom's"], ["3", "", "x\ny"]]
    assert list(dumps.parse_tuples(r"(' a ''b',  7 ,'\q\\'),(4,'open")) == [["a b", "7", "q\\"]]
    assert list(dumps.parse_tuples("")) == [] and list(dumps.parse_tuples("(1,'a,b)')")) == [["1", "a,b)"]]
    with pytest.raises(ValueError):
        list(dumps.parse_tuples("1,2"))


def test_read_dump(spark, tmp_path):
    with gzip.open(tmp_path / "page.sql.gz", "wb") as f:
        f.write(b"-- comment\nINSERT INTO `page` VALUES (1,0,'A_B',''),(2,1,'Talk',''),(3,0,'short');\nINSERT INTO `other` VALUES (9,0,'x','');\nINSERT INTO `page` VALUES (4,0,'bad \xff','');\n")
    path = f"file://{tmp_path}/page.sql.gz"
    assert sorted(tuple(r) for r in dumps.read_page(spark, path).collect()) == [(1, 0, "A_B"), (2, 1, "Talk"), (4, 0, "bad �")]
    assert dumps.read_page(spark, path, limit=1).count() == 1
    assert [tuple(r) for r in dictionary.articles(dumps.read_page(spark, path)).orderBy("page_id").collect()] == [(1, "A_B"), (4, "bad �")]


def test_write_dump(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a'b\\c\n\td"), (2, None), (3, "")], "id long, t string")
    dumps.write_insert_values(rows, f"file://{tmp_path}/out", "t")
    got = dumps.read_insert_values(spark, f"file://{tmp_path}/out", "t").collect()
    assert sorted(r.fields for r in got) == [["1", "a'b\\c\n\td"], ["2", ""], ["3", ""]]


def test_page_props(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "page_id long, title string")
    props = spark.createDataFrame(
        [(1, "wikibase_item", "Q5", 1), (1, "wikibase_item", "Q6", 2), (2, "wikibase_item", "Q7", 1), (2, "wikibase_item", "none", 2), (2, "disambiguation", "", 3), (3, "other", "x", 1), (9, "wikibase_item", "Q1", 1), (3, "wikibase_item", None, 2)],
        "page_id long, propname string, value string, ord long",
    )
    got = [tuple(r) for r in dictionary.attach_props(pages, props).orderBy("page_id").collect()]
    assert got == [(1, "a", 6, False), (2, "b", None, True), (3, "c", None, False), (4, "d", None, False)]


def test_redirects(spark):
    pages = spark.createDataFrame([(1, "A", None), (2, "B", 20), (3, "C_(x)", None), (4, "B", 40)], "page_id long, title string, qid long")
    led = spark.createDataFrame([(1, 0, "B"), (3, 0, "A"), (3, 4, "B"), (7, 0, "B"), (1, 0, "missing"), (3, 0, "B")], "from_id long, namespace int, target_title string")
    got = sorted(tuple(r) for r in dictionary.redirect_surfaces(pages, led).collect())
    assert got == [("a", 20), ("c x", 20)]


ENTITY = {
    "type": "item", "id": "Q1",
    "labels": {"en": {"language": "en", "value": "Alpha"}, "de": {"value": "left out"}},
    "aliases": {"en": [{"value": "A_B"}, {"value": "A B"}, {"value": "---"}]},
    "sitelinks": {"enwiki": {"site": "enwiki", "title": "Alpha_(letter)"}, "dewiki": {"title": "no"}},
    "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {"datavalue": {"value": {"id": "Q4167410"}}}}], "P1": [{"mainsnak": {"datavalue": {"value": "text"}}}]},
}


def test_entities(spark, tmp_path):
    lines = ["[", json.dumps(ENTITY) + ",", json.dumps({"id": "Q2", "labels": {}}) + ",", json.dumps({"id": "P3"}), "", "]"]
    (tmp_path / "all.json.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    entities = dumps.read_entities(spark, f"file://{tmp_path}/all.json.bz2")
    got = sorted(tuple(r) for r in dictionary.entity_surfaces(entities, ["enwiki"]).collect())
    assert got == [("a b", 1), ("alpha", 1), ("alpha letter", 1)]
    assert sorted(tuple(r) for r in dictionary.entity_flags(entities).collect()) == [(1, 1), (2, 0)]
    assert dumps.read_entities(spark, f"file://{tmp_path}/all.json.bz2", limit=1).count() == 1
    assert dictionary.wiki_scope(["zhwiki", "enwiki"]) == (["en", "zh"], ["enwiki", "zhwiki"])
    assert dictionary.wiki_scope(["wiki", "commons"]) == ([], ["commons", "wiki"])
    (tmp_path / "bad.json").write_text("[\n{not json},\n]")
    with pytest.raises(Exception):
        dumps.read_entities(spark, f"file://{tmp_path}/bad.json").collect()


def fixture(spark):
    keys = spark.createDataFrame([("北京", [956]), ("北京大学", [13371, 3918]), ("大学", [3918]), ("上海", [8686])], "surface_key string, qids array<long>").withColumn("qid_count", F.size("qids"))
    flags = spark.createDataFrame([(956, 0), (3918, 0), (13371, 1), (5, 1)], "qid long, flags int")
    known = dictionary.with_surface_ids(keys, 2)
    return known, flags


def test_dictionary(spark):
    known, flags = fixture(spark)
    ids = {r.surface_key: (r.surface_id, r.shard_id, r.utf16_len) for r in known.collect()}
    assert ids == {"上海": (0, 0, 2), "北京": (1, 0, 2), "北京大学": (2, 1, 4), "大学": (3, 1, 2)}
    stats = sorted(tuple(r) for r in dictionary.shard_stats(known).collect())
    assert stats == [(0, 0, 2, 2, 12), (1, 2, 2, 4, 18)]
    assert sorted(tuple(r) for r in dictionary.surface_offsets(known).collect()) == [(0, 0, 1), (1, 1, 1), (2, 2, 2), (3, 4, 1)]
    assert sorted(tuple(r) for r in dictionary.referenced_qids(known, flags).collect()) == [(956, 0), (3918, 0), (8686, 0), (13371, 1)]
    listed = {r.surface_id: [tuple(c) for c in r.candidates] for r in dictionary.attach_flags(known, flags).collect()}
    assert listed[2] == [("Q13371", 13371, True), ("Q3918", 3918, False)]
    codes = {r.ch: r.code for r in dictionary.char_codes(known).collect()}
    assert codes == {"京": 0, "北": 1, "大": 2, "学": 3, "上": 4, "海": 5}
    said = checks.metadata(known, dictionary.referenced_qids(known, flags)).first()
    assert (said.surface_count, said.qid_count, said.disambiguation_count, said.shard_count) == (4, 4, 1, 2)


def test_edges_are_a_set(spark):
    edges = spark.createDataFrame([("b", 2), ("b", 1), ("b", 2), (None, 1), ("a", None), ("\U0001f600", 1), ("ﾮ", 1)], "surface_key string, qid long")
    got = dictionary.with_surface_ids(dictionary.surface_qids(edges, edges)).orderBy("surface_id").collect()
    assert [(r.surface_key, r.qids) for r in got] == [("b", [1, 2]), ("ﾮ", [1]), ("\U0001f600", [1])]
    assert dictionary.with_surface_ids(dictionary.surface_qids(edges.limit(0))).count() == 0


def test_published_dictionary(spark, tmp_path):
    known, flags = fixture(spark)
    path = f"file://{tmp_path}/dict"
    with pytest.raises(ValueError):
        tables.open_dictionary(spark, path)
    tables.publish(known, path, tables.stamped(checks.metadata(known, flags), shard_size=2))
    back = tables.open_dictionary(spark, path, checks.CONTRACT)
    assert back.count() == 4 and tables.read_manifest(spark, path).first().shard_size == 2
    with pytest.raises(ValueError):
        tables.open_dictionary(spark, path, "another contract")


def test_tsv(spark, tmp_path):
    keys = spark.createDataFrame([('a"\t\\n"b', [2, 1]), ("x\ny", [3])], "surface_key string, qids array<long>").withColumn("qid_count", F.size("qids"))
    tables.write_surfaces_tsv(keys, f"file://{tmp_path}/t")
    assert sorted(tuple(r) for r in tables.read_surfaces_tsv(spark, f"file://{tmp_path}/t").collect()) == sorted(tuple(r) for r in keys.collect())
    (tmp_path / "bad.tsv").write_text("surface_key\tqids\tother\na\tQ1\t1\n")
    with pytest.raises(Exception):
        tables.read_surfaces_tsv(spark, f"file://{tmp_path}/bad.tsv").collect()
    (tmp_path / "bad2.tsv").write_text("surface_key\tqids\tqid_count\na\tX1\t1\n")
    with pytest.raises(Exception):
        tables.read_surfaces_tsv(spark, f"file://{tmp_path}/bad2.tsv").collect()


def test_scalar_functions(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]

    assert one("a😀b", T.utf16_length) == 4 and one("", T.utf16_length) == 0 and one(None, T.utf16_length) is None
    assert one("a\\t\\x\\\\n\\", T.tsv_unescape) == "a\t\\x\\n\\"
    numbers = [one(v, T.qid_number) for v in ("Q1", "Q4294967295", "Q4294967296", "Q", "P1", "Q1x", "Q-1", None, "Q99999999999999999999999999999999999999999999")]
    assert numbers == [1, 4294967295, None, None, None, None, None, None, None]
    with pytest.raises(Exception):
        one("P1", T.qid_number_strict)
    assert [one(v, T.is_dump_date) for v in ("latest", "20260101", "2026", "latest1")] == [True, True, False, False]
    assert one(" a, b,,c ", T.split_option) == ["a", "b", "c"]
    assert [one(v, T.component) for v in ("page", "page-props", "wikidata_entities", "x")] == ["page", "page_props", "wikidata_entities", None]
    assert [one(v, T.wiki_language) for v in ("zhwiki", "wiki", "commons")] == ["zh", None, None]
    url = spark.range(1).select(T.dump_url(F.lit("wikidata_entities"), F.lit("enwiki"), F.lit("20260702"))).first()[0]
    assert url == "https://dumps.wikimedia.org/wikidatawiki/entities/20260702/wikidata-20260702-all.json.bz2"
    register(spark)
    assert spark.sql("select normalize_key('A_B') k, normalize_spans('ß').ends e").first() == ("a b", [1, 1])


TEXTS = [(1, "我在北京大学。上海大学"), (2, None), (3, ""), (4, "😀 上海"), (1, "上海"), (None, "上海")]


def brute(rows, keys):
    out = []
    for doc, t in rows:
        norm, starts, ends = normalize_spans(t or "")
        out += [(doc, int(starts[i]), int(ends[i + len(k) - 1]), s) for k, s in keys.items() for i in range(len(norm)) if norm.startswith(k, i)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("method", ["auto", "automaton", "join"])
def test_matches(spark, method):
    known, flags = fixture(spark)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("surface_id", F.lit(99))
    found = matching.find_matches(docs, known, method=method)
    keys = {r.surface_key: r.surface_id for r in known.collect()}
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(TEXTS, keys)
    assert matching.find_matches(docs.limit(0), known, method=method).count() == 0
    assert matching.find_matches(docs, known.limit(0), method=method).count() == 0


def test_same_place_twice(spark):
    known = spark.createDataFrame([("s", 0), ("ss", 1)], "surface_key string, surface_id long")
    docs = spark.createDataFrame([(1, "ß")], "doc_id long, text string")
    for method in ("automaton", "join"):
        assert sorted(tuple(r) for r in matching.find_matches(docs, known, method=method).collect()) == [(1, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1)]


def test_long_text(spark):
    known = spark.createDataFrame([("ab", 0), ("b" * 50, 1)], "surface_key string, surface_id long")
    docs = spark.createDataFrame([(1, "ab " * 30_000 + "b" * 60)], "doc_id long, text string")
    for method in ("automaton", "join"):
        assert matching.find_matches(docs, known, method=method).count() == 30_000 + 11


def test_candidates(spark):
    known, flags = fixture(spark)
    known = dictionary.attach_flags(known, spark.createDataFrame([(956, 1), (13371, 1)], "qid long, flags int"))
    docs = spark.createDataFrame([(1, "我在北京大学")], "doc_id long, text string")
    found = matching.find_matches(docs, known)
    said = lambda **kw: sorted((r.start, r.end, [c.qid for c in r.qids]) for r in matching.with_candidates(found, known, **kw).collect())
    assert said() == [(2, 4, ["Q956"]), (2, 6, ["Q13371", "Q3918"]), (4, 6, ["Q3918"])]
    assert said(include_disambiguation=False) == [(2, 6, ["Q3918"]), (4, 6, ["Q3918"])]
    assert said(most=1) == said(most=0) == [(2, 4, ["Q956"]), (2, 6, ["Q13371"]), (4, 6, ["Q3918"])]
    lines = [r.line for r in matching.events(docs, matching.with_candidates(found, known)).orderBy("seq").collect()]
    assert json.loads(lines[0]) == {"type": "match", "match": {"start": 2, "end": 4, "surface_id": 1, "shard_id": 0, "qids": [{"qid": "Q956", "qid_number": 956, "disambiguation": True}]}}
    assert lines[-1] == '{"type":"done","stats":{"matches":3}}' and len(lines) == 4
    assert sorted(tuple(r)[1:3] for r in matching.longest_per_end(found).collect()) == [(2, 4), (2, 6)]
    assert sorted(tuple(r)[1:3] for r in matching.first_matches(docs, known, 2).collect()) == [(2, 4), (2, 6)]
    assert sorted((r.start, r.end, len(r.qids)) for r in matching.with_candidates(found, known, most_keys=0).collect()) == [(2, 4, 1), (2, 6, 2), (4, 6, 1)]


def test_doctor(spark):
    rows = spark.createDataFrame([(1, "a", "Q1|Q2", 2), (1, "a", "Q1|Q2", 2), (2, "", "Q1", 2), (3, "c", "Q1|X", None), (4, "c", None, 0)], "surface_id long, surface_key string, qids string, qid_count int")
    assert sorted(tuple(r) for r in checks.violations(rows).collect()) == [(1, "repeated_id"), (2, "empty_key"), (2, "wrong_count"), (3, "bad_qid"), (3, "repeated_key"), (3, "wrong_count")]


MESSAGES = [
    '{"type":"start","options":{"max_candidates_per_surface":1}}', '{"type":"chunk","text":"我在北"}', '{"type":"chunk","text":"京大"}', "not json", '{"type":"chunk"}', '{"type":"chunk","text":"学"}',
    '{"type":"end"}', '{"type":"chunk","text":"大学"}', '{"type":"end"}', None, '{"type":"start","options":{"include_disambiguation":false}}', '{"type":"chunk","text":"北京大学"}', '{"type":"start","options":{"include_disambiguation":1}}',
]


def test_sessions(spark, tmp_path):
    known, _ = fixture(spark)
    known = dictionary.attach_flags(known, spark.createDataFrame([(956, 1), (13371, 1)], "qid long, flags int"))
    rows = [(s, i, m) for s in ("a", "b", None) for i, m in enumerate(MESSAGES)]
    messages = spark.createDataFrame(rows, "session_id string, seq long, payload string")
    got = sorted(tuple(r) for r in sessions.match_sessions(messages, known).where("session_id = 'a'").collect())
    events = [json.loads(r[3]) for r in got]
    kinds = [(e["type"], e.get("match", e.get("stats", {})).get("start", e.get("received_chars"))) for e in events]
    assert kinds == [("started", None), ("ack", 3), ("match", 2), ("ack", 5), ("error", None), ("error", None), ("match", 2), ("match", 4), ("ack", 6), ("done", None), ("match", 0), ("ack", 2), ("done", None), ("error", None), ("started", None), ("match", 0), ("match", 2), ("ack", 4), ("error", None)]
    assert [e["stats"]["matches"] for e in events if e["type"] == "done"] == [3, 1]
    assert [len(e["match"]["qids"]) for e in events if e["type"] == "match"] == [1, 1, 1, 1, 1, 1]
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in (messages.where("seq < 2"), messages.where("seq >= 2")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(messages.schema).parquet(source)
        query = sessions.match_stream(stream, known).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/point").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).where("session_id = 'a'").collect()) == got
    assert json.loads(sessions.interrupted("shutdown")) == {"type": "interrupted", "reason": "shutdown"}


def talk(spark):
    """A dictionary and the messages of sessions in pieces of many sizes, with blanks and characters that vanish or become several at their ends; the messages of ``MESSAGES`` too."""
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip().replace("  ", " ") for _ in range(60)} - {""} | {"我", "北京", "京大学"})
    rows = [(k, i, i // 10, [(f"Q{j}", j, j % 3 == 0) for j in range(i % 4)]) for i, k in enumerate(keys)]
    known = spark.createDataFrame(rows, "surface_key string, surface_id long, shard_id int, candidates array<struct<qid: string, qid_number: long, disambiguation: boolean>>")
    rows = [("fixed", i, m) for i, m in enumerate(MESSAGES)] + [(None, 0, MESSAGES[0])]
    for s in range(12):
        sent = [{"type": "start", "options": rng.choice([{}, {"include_disambiguation": False}, {"max_candidates_per_surface": rng.choice([0, 1, 1 << 40])}])}]
        sent += [{"type": "chunk", "text": "".join(rng.choice("abc AB-\u00ad\ud800㏂ﬀ𝒶") for _ in range(rng.choice([0, 1, 5, 60])))} for _ in range(rng.randint(0, 9))]
        rows += [(str(s), i, json.dumps(m)) for i, m in enumerate([*sent, {"type": "end"}] * 2)]
    return known, spark.createDataFrame(rows, "session_id string, seq long, payload string")


def test_sessions_of_a_dictionary_beyond_the_automaton(spark, monkeypatch):
    known, messages = talk(spark)
    rows = lambda: sorted(tuple(r) for r in sessions.match_sessions(messages, known).collect())
    want = rows()
    assert sum('"match"' in r[3] for r in want) > 200
    monkeypatch.setattr(sessions, "BROADCAST_KEYS", 5)
    assert rows() == want
    monkeypatch.setattr(sessions, "FILTER_BYTES", 8)  # a filter that denies hardly anything
    assert rows() == want


def test_streams_of_a_dictionary_beyond_the_automaton(spark, tmp_path, monkeypatch):
    known, messages = talk(spark)
    want = sorted(tuple(r) for r in sessions.match_sessions(messages, known).collect())
    monkeypatch.setattr(sessions, "BROADCAST_KEYS", 5)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in (messages.where("seq < 4"), messages.where("seq >= 4")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(messages.schema).parquet(source)
        query = sessions.match_stream(stream, known).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/point").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want


def test_readers_during_a_second_publish(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    make = lambda n: spark.range(n).selectExpr("id as surface_id", "cast(floor(id / 10) as int) as shard_id", "concat('k', id) as surface_key")
    facts = lambda n: spark.createDataFrame([(n,)], "surface_count long")
    tables.publish(make(20), path, facts(20))
    seen, done = [], threading.Event()

    def watch():
        while not done.is_set():
            folder = tmp_path / "dictionary"
            version = max(x.name for x in folder.iterdir() if x.name.startswith("version-"))
            seen.append((version, len(list((folder / version / "data").glob("shard_id=*/*.parquet"))) > 0, (folder / version / "manifest").exists()))

    watcher = threading.Thread(target=watch)
    watcher.start()
    opened = tables.open_dictionary(spark, path)
    tables.publish(make(35), path, facts(35))
    done.set()
    watcher.join()
    assert len(seen) > 10 and all(data and facts for _, data, facts in seen)
    assert opened.count() == 20 and tables.open_dictionary(spark, path).count() == 35  # who has it open reads on
    tables.publish(make(35).where("surface_id != 12"), path, facts(34))
    with pytest.raises(ValueError):
        tables.open_dictionary(spark, path)
    tables.publish(make(30), path, facts(31))
    with pytest.raises(ValueError):
        tables.open_dictionary(spark, path)
    assert len([p for p in (tmp_path / "dictionary").iterdir() if p.name.startswith("version-")]) == 2


def test_stage_counts(spark):
    pages = spark.createDataFrame([(1, "a", 1, True), (2, "b", None, False)], "page_id long, title string, qid long, is_disambiguation boolean")
    entities = spark.read.schema(dumps.ENTITY).json(spark.sparkContext.parallelize([json.dumps(ENTITY)]))
    got = {r.stage: r.n for r in dictionary.stage_counts(pages, pages.limit(0), entities, ["enwiki"]).collect()}
    assert got == {"pages": 2, "pages_with_qid": 1, "disambiguation_pages": 1, "redirect_surfaces": 0, "entities": 1, "entity_surfaces": 3}


def test_hashes():
    text = "abc\U0001f600abcab" * 7
    hashes = matching.Hashes(matching.code_points(text))
    for n in (1, 3, 6):
        parts = [text[i : i + n] for i in range(len(text) - n + 1)]
        got = hashes.of(np.arange(len(parts)), n).tolist()
        assert got == [int(matching.Hashes(matching.code_points(p)).of(np.array([0]), n)[0]) for p in parts] and len(set(got)) == len(set(parts))


@pytest.mark.parametrize("how, first", [("overlapping", False), ("longest_per_end", False), ("standard", False), ("leftmost", False), ("leftmost", True)])
def test_the_join_agrees_with_the_automaton(spark, how, first):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n)).strip() or "a"
    keys = sorted({word(rng.randint(1, 12)).replace("  ", " ") for _ in range(120)}, key=lambda k: rng.random())
    known = spark.createDataFrame(list(zip(keys, range(len(keys)))), "surface_key string, surface_id long")
    docs = spark.createDataFrame([(i, word(rng.randint(0, 60))) for i in range(150)] + [(None, "ab a"), (900, None)], "doc_id long, text string")
    a, b = (sorted((tuple(r) for r in matching.find_matches(docs, known, method=m, how=how, first=first).collect()), key=repr) for m in ("automaton", "join"))
    assert a == b and a


def test_a_dictionary_beyond_the_automaton(spark, monkeypatch):
    """Its keys are taken in slices of a small filter; little more moves than is found."""
    monkeypatch.setattr(matching, "BROADCAST_KEYS", 1000)
    known = spark.range(5000).selectExpr("concat('key', lpad(cast(id * 7 as string), 5, '0'), repeat('x', cast(id % 40 as int))) as surface_key", "id as surface_id")
    rows = [(i, f"say key{(i * 7) % 35000:05d}{'x' * 40} and key00003 no") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.surface_key: r.surface_id for r in known.collect()}
    want = brute(rows, keys)
    assert sorted((tuple(r) for r in matching.find_matches(docs, known).collect()), key=repr) == want
    assert sorted((tuple(r) for r in matching.find_by_join(docs, known, "doc_id", "text", filter_bytes=4000).collect()), key=repr) == want
    with pytest.raises(ValueError):
        matching.find_by_automaton(docs, known, "doc_id", "text")
    sent = spark.sparkContext.broadcast((matching.key_filter(known, 5000 * 24 // 64), sorted({len(k) for k in keys})))
    moved = docs.mapInArrow(matching._stretches(sent, "doc_id"), "doc_id long, surface_key string, _a int, _b int, start int, `end` int").count()
    assert len(want) <= moved <= 1.2 * len(want)
    assert matching.first_matches(docs, known, 1).count() == len({d for d, *_ in want})
    assert sorted(tuple(r) for r in matching.first_matches(docs, known.where("surface_id < 900"), 1).collect()) == sorted({d: (d, a, b, s) for d, a, b, s in sorted(w for w in want if w[3] < 900)[::-1]}.values())
