"""Commands over a folder of files."""

import pytest

from tarnlight import cli


def test_commands(spark, tmp_path, capsys):
    source, state = tmp_path / "files", f"file://{tmp_path}/state"
    for name, text in {"a/one.md": "Liability cap: INR 4 crore", "a/two.txt": "Parking is free", "b/raw.txt": "x\0y", "Update/copy.txt": "Parking is free"}.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(text)

    def said(*args, code=0):
        assert cli.main([state, *args], spark) == code
        return capsys.readouterr().out

    assert cli.main([state, "sync"], spark) == 2
    said("init", f"file://{source}")
    out = said("sync")
    assert "4 new" in out and "1 read as unsupported" in out and "3 read as ok" in out
    assert "a/two.txt" in said("search", "parking") and said("search", "zzzz", code=1).strip() == ""
    assert "4 crore" in said("packet", "liability cap")
    assert said("dedup").split() == ["Update/copy.txt", "a/two.txt"]
    assert "unsupported" in said("failed") and "BAD" not in said("doctor")
    (source / "a/two.txt").write_text("Parking costs 5 euro")
    assert "a/two.txt\tmodified" in said("status") and said("sync") and said("status").strip() == ""
    assert "changed" in said("history")
    assert "a\t2\t0" in said("dump", f"file://{tmp_path}/dumps")
    assert "FILE: a/one.md" in next((tmp_path / "dumps/top_folder=a/part=1").glob("part-*")).read_text()
    assert said("purge").strip().startswith("versions left: [")
    assert cli.main([state, "search", "?"], spark) == 2


def test_paths_stay_inside():
    assert cli.confined("/data/", "a/../b") == "/data/b"
    for bad in ("../x", "/etc/passwd", "a/../../x", "s3://other/x"):
        with pytest.raises(cli.Outside):
            cli.confined("/data", bad)
