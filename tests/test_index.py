"""A corpus from files to packet: readers, sync, search, conflicts, state."""

import io
import zipfile

import pytest

from tarnlight import reachable
from tarnlight.operators import evidence, search
from tarnlight.plans.corpus_index import CorpusIndex
from tarnlight.plans.packet import EmptyTask
from tarnlight.plans.state import State, StateError
from tarnlight.sources import corpus, readers
from tarnlight.streaming import ingest

TEXTS = {
    "contracts/master_signed.md": "Master agreement with Helios Components Pvt Ltd as the Vendor. Liability cap: INR 4.2 crore. Payment terms: Net-45 days. Governing law: Karnataka.",
    "contracts/old_draft.md": "Draft. Liability cap: INR 6 crore. Vendor: Helios Components Pvt Ltd. Effective date: 01/02/2026.", "misc/note.txt": "Lunch menu is on page 3. Nothing else.", "misc/other.txt": "Parking is free for all visitors.",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "rel string, text string")


def test_sync_search_and_packet(spark, tmp_path):
    ix = CorpusIndex(spark, f"file://{tmp_path}/state", evidence.STARTER_ALIASES)
    with pytest.raises(StateError):
        ix.table("chunks")
    assert ix.sync(frame(spark, TEXTS)).counts == {"new": 4}
    assert ix.search_one("parking")[0]["rel"] == "misc/other.txt"
    with pytest.raises(search.EmptyQuery):
        ix.search_one("!!")
    assert ix.search_one("zzzz") == []
    packet = ix.packet("fill the vendor form", fields=["Legal name", "Liability cap", "Effective date", "GST number"], explain=True)
    assert "- Legal name: Helios Components Pvt Ltd  [contracts/" in packet and "- Effective date: 01/02/2026." in packet
    assert "- Liability cap: 2 values disagree" in packet and "- GST number: not found (tried: gst, number)" in packet
    assert "Coverage: 4 fields · 3 found · 0 weak · 1 missing" in packet
    assert packet == ix.packet("fill the vendor form", fields=["Legal name", "Liability cap", "Effective date", "GST number"], explain=True)
    small = ix.packet("liability cap", budget=90)
    assert "over budget" in small and "## Dropped (budget)" in small
    assert "nothing was retrieved" in ix.packet("liability cap", budget=0)
    with pytest.raises(EmptyTask):
        ix.packet("?!")
    assert [r["rel"] for r in ix.semantic("parking visitors").collect()][0] == "misc/other.txt"

    changed = dict(TEXTS)
    changed["misc/note.txt"] = "The liability is 5 crore."
    changed["contracts/renamed.md"] = changed.pop("contracts/old_draft.md")
    changed["Update/copy.txt"] = changed["misc/other.txt"]
    report = ix.sync(frame(spark, changed))
    assert report.counts == {"changed": 1, "moved_away": 1, "unchanged": 2, "renamed": 1, "new": 1} and not report.errors
    assert ix.sync(frame(spark, changed)).counts == {"unchanged": 5}
    assert {r["rel"] for r in ix.table("chunks").collect()} == set(changed)
    assert all(r["ok"] for r in ix.health().collect())
    assert [(r["rel"], r["original"]) for r in ix.duplicates().collect()] == [("Update/copy.txt", "misc/other.txt")]
    again = CorpusIndex(spark, f"file://{tmp_path}/fresh", evidence.STARTER_ALIASES)
    again.sync(frame(spark, changed))
    ask = spark.createDataFrame([(0, "liability crore cap")], "query_id int, query string")
    rows = lambda i: [(r["rel"], round(r["score"], 9)) for r in i.search(ask).orderBy("rank").collect()]
    assert rows(ix) == rows(again)
    ix.state.drop_before(ix.state.versions()[-1])
    assert len(ix.state.versions()) == 1 and ix.state.history().filter("action = 'renamed'").count() == 1


def test_a_broken_index_is_an_error_and_a_failed_build_leaves_the_old_one(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/s")
    v = state.begin()
    state.write(v, "t", spark.range(3))
    assert state.versions() == []
    state.commit(v)
    with pytest.raises(StateError):
        state.commit(v)
    state.write(state.begin(), "t", spark.range(9))
    assert state.read("t").count() == 3
    empty = CorpusIndex(spark, f"file://{tmp_path}/e")
    empty.sync(frame(spark, {"a.txt": ""}))
    with pytest.raises(search.EmptyIndex):
        empty.search_one("word")


def package(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), content)
    return out.getvalue()


def test_readers():
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl><w:p><w:t>Two</w:t></w:p></w:body></w:document>'
    assert readers.read_one("x.docx", ".docx", package(word__document_xml=doc), {}) == ("One\nTwo\na | b", "ok", "")
    slide = '<p xmlns:a="a"><sp><a:p><a:t>Title</a:t></a:p></sp><graphicFrame><a:tr><a:tc><a:p><a:t>x</a:t></a:p></a:tc></a:tr></graphicFrame></p>'
    assert readers.read_one("x.pptx", ".pptx", package(ppt__slides__slide1_xml=slide), {})[0] == "\n--- SLIDE 1 ---\nTitle\nx"
    book = package(xl__workbook_xml='<w><sheet name="S"/></w>', xl__sharedStrings_xml="<s><si><t>k</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row/></w>')
    assert readers.read_one("x.xlsx", ".xlsx", book, {})[0] == "\n=== SHEET: S ===\nk\t\t5"
    moved = package(xl__workbook_xml='<w xmlns:r="r"><sheet name="First" r:id="rId2"/><sheet name="Second" r:id="rId1"/></w>', xl__worksheets__sheet1_xml='<w><row><c r="A1"><v>2</v></c></row></w>', xl__worksheets__sheet2_xml='<w><row><c r="A1"><v>1</v></c></row></w>')
    with zipfile.ZipFile(moved := io.BytesIO(moved), "a") as z:
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></R>')
    assert readers.read_one("x.xlsx", ".xlsx", moved.getvalue(), {})[0] == "\n=== SHEET: First ===\n1\n\n=== SHEET: Second ===\n2"
    assert readers.read_one("x.txt", ".txt", b"\x7f" * 9 + b"a", {})[:2] == ("a", "ok") and readers.read_one("x.txt", ".txt", b"\x08" * 9 + b"a", {})[1] == "unsupported"
    assert readers.read_one("x.docx", ".docx", b"PK broken", {})[1] == "failed" and readers.read_one("x.zip", ".zip", b"", {})[1] == "unsupported"
    assert readers.read_one("x.txt", ".txt", b"a\0b", {})[1] == "unsupported" and readers.read_one("x.txt", ".txt", b" \n", {})[1] == "empty" and readers.read_one("x.txt", ".txt", b"\xff ok", {})[0] == "� ok"
    assert readers.passwords_for("a/b.pdf", {"b": "1", "z": "2", "": "3"}) == ["", "1", "3"]
    assert "office file" in readers.describe(ValueError(), readers.OLE2 + b"x")


def test_secrets_and_failures(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "good.json").write_text('{"contracts/": "pw", "n": 3}')
    path = lambda name: f"file://{tmp_path}/{name}.json"
    assert readers.read_secrets(spark, path("none"), path("bad"), path("good")) == {"contracts/": "pw"}
    assert readers.read_secrets(spark, path("none")) == {}
    wrong = type("PDFPasswordIncorrect", (Exception,), {})()
    assert readers.describe(wrong, b"", 1) != readers.describe(wrong, b"", 0) and "middle" in readers.describe(type("PSEOF", (Exception,), {})(), b"")


def test_walk_and_stream(spark, tmp_path):
    reachable(spark)
    root = tmp_path / "src"
    for name in ("a b.md", "sub/c+d.txt", ".hidden", "~$lock.docx", "node_modules/x.txt", ".git/y.txt", "evidence_home/z.txt", "evidence_home/Update/u.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name} with liability")
    rows = corpus.folder_files(spark, f"file://{root}")
    assert {r["rel"] for r in rows.collect()} == {"a b.md", "sub/c+d.txt", "evidence_home/Update/u.txt"}
    stat = {r["rel"]: r for r in corpus.stat_rows(rows).collect()}
    assert stat["a b.md"]["ext"] == ".md" and stat["a b.md"]["folder"] == "." and stat["evidence_home/Update/u.txt"]["top_folder"] == "Update" and len(stat["a b.md"]["sha1"]) == 40
    assert {(r["rel"], r["status"]) for r in readers.extracted(rows).collect()} == {("a b.md", "ok"), ("sub/c+d.txt", "ok"), ("evidence_home/Update/u.txt", "ok")}
    ix = CorpusIndex(spark, f"file://{tmp_path}/state")
    follow = lambda: ingest.follow(ingest.file_stream(spark, f"file://{root}"), ix, f"file://{tmp_path}/ck").awaitTermination(120)
    follow()
    assert len(ix.search_one("liability")) == 3
    (root / "new.txt").write_text("liability again, and a unicorn")
    follow()
    assert len(ix.search_one("liability")) == 4 and ix.search_one("unicorn")[0]["rel"] == "new.txt"


def test_state_files_are_checked(spark, tmp_path):
    good, bad = tmp_path / "g.tsv", tmp_path / "b.tsv"
    good.write_text("path\tsize\na\t1\n\na\t2\nb\t\n")
    bad.write_text("path\tsize\na\n")
    assert sorted((r["path"], r["size"]) for r in readers.table_of_tsv(spark, f"file://{good}", ["path", "size"], "path").collect()) == [("a", "2"), ("b", None)]
    with pytest.raises(Exception, match="another number of cells"):
        readers.table_of_tsv(spark, f"file://{bad}", ["path", "size"], "path").collect()
    with pytest.raises(ValueError):
        readers.table_of_tsv(spark, f"file://{good}", ["path", "x"], "path")
