import bz2
import gzip
import io
import json
from types import SimpleNamespace

import pytest

from corpuscle import __main__ as cli
from corpuscle import pipeline
from corpuscle.__main__ import main


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("build")
    folder = root / "dumps/enwiki/latest"
    folder.mkdir(parents=True)
    (root / "dumps/wikidatawiki/latest").mkdir(parents=True)
    said = {
        "page": "(1,0,'Alan_Turing',''),(2,0,'Turing',''),(3,0,'Enigma_(disambiguation)',''),(4,1,'Talk',''),(5,0,'No_entity','')",
        "page_props": "(1,'wikibase_item','Q7251'),(3,'wikibase_item','Q3'),(3,'disambiguation','')",
        "redirect": "(2,0,'Alan_Turing','',''),(5,0,'missing','','')",
    }
    for table, values in said.items():
        with gzip.open(folder / f"enwiki-latest-{table}.sql.gz", "wt") as f:
            f.write(f"INSERT INTO `{table}` VALUES {values};\n")
    entities = [{"id": "Q7251", "labels": {"en": {"value": "A. M. Turing"}}, "aliases": {}, "sitelinks": {}}, {"id": "Q9", "labels": {"en": {"value": "Enigma"}}, "claims": {"P31": []}}]
    lines = ["[", *(json.dumps(e) + "," for e in entities), "]"]
    (root / "dumps/wikidatawiki/latest/latest-all.json.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    base = f"file://{root}"
    pipeline.preprocess(spark, f"{base}/dumps", f"{base}/pre", ["enwiki"])
    pipeline.compile_dictionary(spark, f"{base}/pre", f"{base}/run", shard_size=2)
    return f"{base}/run"


def test_build(spark, built):
    known = {r.surface_key: (r.surface_id, r.shard_id, [tuple(c) for c in r.candidates]) for r in pipeline.open_runtime(spark, built).collect()}
    turing = [("Q7251", 7251, False)]
    assert known == {
        "a m turing": (0, 0, turing), "alan turing": (1, 0, turing), "enigma": (2, 1, [("Q9", 9, False)]), "enigma disambiguation": (3, 1, [("Q3", 3, True)]), "turing": (4, 2, turing),
    }
    assert [tuple(r) for r in spark.read.parquet(f"{built}/qids").orderBy("qid").collect()] == [(3, 1), (9, 0), (7251, 0)]


def test_commands(spark, built, capsys, monkeypatch):
    assert main(["normalize", "--text", "Ｗｉｋｉ_Title"]) == 0 and capsys.readouterr().out == "wiki title\n"
    assert main(["normalize", "--text", " - "]) == 0 and capsys.readouterr().out == "\n"
    assert main(["match", "--data-dir", built, "--text", "Alan-Turing!"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(x["type"], x.get("match", {}).get("start")) for x in lines] == [("match", 0), ("match", 5), ("done", None)]
    monkeypatch.setenv("CORPUSCLE_DATA_DIR", built)
    assert main(["match", "--text", "enigma (disambiguation)", "--exclude-disambiguation"]) == 0
    assert [json.loads(x)["type"] for x in capsys.readouterr().out.splitlines()] == ["match", "done"]
    assert main(["status"]) == 0 and json.loads(capsys.readouterr().out)["surface_count"] == 5
    assert main(["doctor"]) == 0 and capsys.readouterr().out == "ok\n"
    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    assert main(["targets"]) == 0 and len(capsys.readouterr().out.splitlines()) == 7
    with pytest.raises(SystemExit):
        main(["unknown"])


def test_input_in_pieces(spark, built, capsys, monkeypatch):
    """A character that is cut between two reads is whole; matches cross pieces."""
    monkeypatch.setattr(cli, "PIECE", 3)
    text = "ü Ａlan-Turing, Enigma"
    for command in (["normalize"], ["match", "--data-dir", built]):
        monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(text.encode())))
        assert main(command) == 0
    first, *lines = capsys.readouterr().out.splitlines()
    assert first == "u alan turing enigma"
    found = [json.loads(x) for x in lines]
    assert [(x["match"]["start"], x["match"]["end"]) for x in found[:-1]] == [(2, 13), (7, 13), (15, 21)] and found[-1]["stats"]["matches"] == 3
    monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO("ü".encode()[:1])))
    with pytest.raises(ValueError):
        main(["normalize"])


def test_sql(spark, built):
    pipeline.register_matcher(pipeline.open_runtime(spark, built))
    got = spark.sql("select inline(match_text(t)) from values ('Alan Turing'), (null), ('') as v(t)").collect()
    assert [tuple(r) for r in got] == [(0, 11, 1), (5, 11, 4)]


@pytest.mark.parametrize("wrong", [{"wikis": []}, {"wikis": [" "]}, {"components": ["x"]}, {"date": "2026"}])
def test_wrong_targets(spark, wrong):
    with pytest.raises(ValueError):
        pipeline.targets(spark, "out", **wrong)
