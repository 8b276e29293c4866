"""Files to pages, the ledger, bundles and archives."""

import hashlib
import json
import zipfile

import pytest

from evispark.sources import documents, stores

DOC = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t><w:footnoteReference w:id="2"/><w:cr/><w:t>again</w:t></w:r></w:p>
<w:tbl/><w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>Arm</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>N</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>5</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
NOTES = """<w:footnotes xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:footnote w:id="-1"><w:p><w:r><w:t>separator</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>A note.</w:t></w:r></w:p></w:footnote><w:footnote w:id="1"><w:p><w:r><w:t>First</w:t><w:br/><w:t>note.</w:t></w:r></w:p></w:footnote></w:footnotes>"""


def test_dossier_to_pages(spark, tmp_path):
    trial = tmp_path / "input" / "trial-1"
    trial.mkdir(parents=True)
    (trial / "main.txt").write_bytes("﻿Page é".encode())
    (trial / "table.csv").write_text("a,b")
    (trial / "registry.json").write_text(json.dumps({"officialTitle": "T", "arms": [{"armGroup": "A", "n": 3}, {"armGroup": "B|C", "n": None}], "tags": ["x", True]}))
    (trial / "bad.json").write_text('{"x": NaN}')
    (trial / ".hidden.txt").write_text("no")
    (trial / "picture.png").write_bytes(b"\x89PNG")
    (trial / "scan.bin").write_bytes(b"%PDF-1.7 x")
    with zipfile.ZipFile(trial / "letter.docx", "w") as out:
        out.writestr("word/document.xml", DOC)
        out.writestr("word/footnotes.xml", NOTES)
    files = documents.dossier(spark, str(tmp_path / "input"))
    found = {r.path.rpartition("/")[2]: (r.page, r.text, r.error) for r in documents.pages(files).collect()}
    assert set(found) == {"main.txt", "table.csv", "registry.json", "bad.json", "scan.bin", "letter.docx"}
    assert found["main.txt"] == (1, "Page é", None) and found["bad.json"][1] is None and "NaN" in found["bad.json"][2] and found["scan.bin"][2].startswith("KeyError")
    assert found["letter.docx"][1].split("\n") == ["Hello there[FOOTNOTE 2]", "again", "[TABLE 1 START]", "HEADER: | Arm | N |", "ROW 2: | A | 5 |", "[TABLE 1 END]", "[FOOTNOTES]", "FOOTNOTE 1: First note.", "FOOTNOTE 2: A note."]
    assert "- Official title: T" in found["registry.json"][1] and "| B\\|C | |" in found["registry.json"][1] and "- true" in found["registry.json"][1]
    two = documents.pages(files.where("format = 'pdf'"), {"pdf": lambda content: ["one", "two"]}).collect()
    assert [(r.page, r.text) for r in two] == [(1, "one"), (2, "two")]
    stores.archive(files, str(tmp_path / "a.zip"))
    assert stores.archive_defects(str(tmp_path / "a.zip")) == []


def test_pinned_record_manifest_and_transcript(spark, tmp_path):
    record = tmp_path / "r.json"
    record.write_text('{"a": 1}')
    pin = hashlib.sha256(record.read_bytes()).hexdigest()
    assert documents.replayed_record(spark, str(record), pin).first().record == '{"a": 1}'
    with pytest.raises(Exception, match="hash differs"):
        documents.replayed_record(spark, str(record), "0" * 64).collect()
    (tmp_path / "sources.toml").write_text('nct = "NCT00000001"\n[roles]\n"main.txt" = "main_article"\n')
    assert documents.manifest(str(tmp_path / "sources.toml"))["roles"] == {"main.txt": "main_article"}
    (tmp_path / "wrong.toml").write_text("other = 1")
    with pytest.raises(ValueError):
        documents.manifest(str(tmp_path / "wrong.toml"))
    (tmp_path / "t.jsonl").write_bytes('﻿{"type": "thread.started"}\r\n\n{"type": "item.started", "item": {"id": "c1"}}\n'.encode())
    events = documents.transcript(spark, str(tmp_path / "t.jsonl"), "type string, item struct<id:string>").orderBy("ordinal").collect()
    assert [(e.event.type, e.event.item and e.event.item.id) for e in events] == [("thread.started", None), ("item.started", "c1")]
    assert [e.ordinal for e in events] == [1, 3]
    long = [json.dumps({"type": f"t{i}", "item": {"id": "x" * 50}}) for i in range(3_000)]
    (tmp_path / "long.jsonl").write_text("\n".join(long))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    many = documents.transcript(spark, str(tmp_path / "*o*.jsonl"), "type string").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(e.ordinal, e.event.type) for e in many} == {(i + 1, f"t{i}") for i in range(3_000)}
    (tmp_path / "bad.jsonl").write_text('{"type": "x"}\n{"type": \n')
    with pytest.raises(Exception):
        documents.transcript(spark, str(tmp_path / "bad.jsonl"), "type string").collect()


def test_ledger_is_append_only_and_compares_revisions(spark, tmp_path):
    ledger, schema = str(tmp_path / "ledger"), "identity string, payload_hash string, payload string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert stores.revision(spark, ledger) == 0 and stores.read_ledger(spark, ledger, schema).count() == 0
    assert stores.commit(rows(("a", "1", "x"), ("a", "1", "x"), ("b", "2", "y")), ledger, 0) == 1
    assert stores.commit(rows(("a", "1", "x"), ("c", "3", "z")), ledger, 1) == 2
    assert sorted((r.identity, r.revision) for r in stores.read_ledger(spark, ledger, schema).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    with pytest.raises(RuntimeError):
        stores.commit(rows(("d", "4", "w")), ledger, 1)
    with pytest.raises(ValueError):
        stores.commit(rows(("a", "other", "x")), ledger, 2)
    assert stores.revision(spark, ledger) == 2


def test_rebuild_bundle_and_dump(spark, tmp_path):
    store = str(tmp_path / "store")
    first = stores.rebuild(spark.range(3), store)
    second = stores.rebuild(spark.range(5), store)
    assert first != second and stores.current(spark, store).count() == 5
    records = spark.createDataFrame([("b", "é"), ("a", None)], "identity string, payload string")
    one, two = (stores.bundle(records.orderBy(c), str(tmp_path / f"{c}.zip")) for c in ("identity", "payload"))
    assert one == two and stores.verify_bundle(str(tmp_path / "identity.zip"))
    assert (tmp_path / "identity.zip").read_bytes() == (tmp_path / "payload.zip").read_bytes()
    stores.dump({"b": 1, "a": "é"}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_bytes() == '{"a":"é","b":1}\n'.encode()
