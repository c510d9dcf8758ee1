import json
import subprocess

import pytest

from orrery import config
from orrery.operators import emit
from orrery.sources import commits, events


def test_commit_log(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    git("init", "-q")
    for name in ("src/a.ts", "src/b.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
        git("add", "-A")
        git("commit", "-qm", f"add {name}")
    rows = commits.commit_log(spark, [str(tmp_path)]).collect()
    assert {(r["subject"], tuple(r["files"])) for r in rows} == {("add src/a.ts", ("src/a.ts",)), ("add src/b.ts", ("src/b.ts",))}
    assert commits.commit_log(spark, [str(tmp_path)], paths="src/a.ts").count() == 1
    state = commits.tree_state(str(tmp_path))
    assert state["commit"] and not state["dirty"]
    (tmp_path / "c").write_text("x")
    assert commits.tree_state(str(tmp_path))["dirty"] and commits.tree_state("/nowhere") == {"commit": None, "dirty": True}


def test_events(spark, tmp_path):
    lines = [{"repo": "r", "path": "a.ts", "kind": "add", "ts": "2025-01-01T00:00:00"}, {"repo": "r", "path": "tmp/b", "kind": "change", "ts": "2025-01-01T00:00:00"}, {"repo": "r", "path": "x/node_modules/c", "kind": "add", "ts": "2025-01-01T00:00:00"}, {"repo": "r", "path": "d", "kind": "other", "ts": "2025-01-01T00:00:00"}, {"repo": "q", "path": None, "kind": "add", "ts": None}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, lines)))
    found = events.file_events(spark, str(tmp_path), streaming=False)
    assert found.count() == 3
    options = spark.createDataFrame([("r", ["tmp/"])], "repo string, ignore_extra array<string>")
    assert [r["path"] for r in events.without_ignored(found, options).collect()] == ["a.ts"]


def test_cards_on_disk(spark, tmp_path):
    rows = [("1", "good-card", "observed", "# Body\n---\nmore: yes\n"), ("2", "../evil", "observed", "x"), ("3", None, "observed", "x"), ("4", "empty", "emerging", None)]
    df = spark.createDataFrame(rows, "id string, slug string, maturity string, body string").coalesce(1)
    assert [r["status"] for r in emit.emit_cards(df, str(tmp_path)).collect()] == ["written", "refused", "refused", "written"]
    assert [r["status"] for r in emit.emit_cards(df, str(tmp_path)).collect()] == ["unchanged", "refused", "refused", "unchanged"]
    path = tmp_path / "observed" / "good-card" / "SKILL.md"
    head, body = emit.read_card(path.read_text())
    assert head["id"] == "1" and body == rows[0][3]
    path.write_text(path.read_text() + "edited")
    assert emit.emit_cards(df, str(tmp_path)).head()["status"] == "written"
    assert emit.read_card("no head") == ({}, "no head")


def test_config(tmp_path):
    assert config.load_config(None) == config.Config() and config.load_config(str(tmp_path / "x")) == config.Config()
    path = tmp_path / "c.toml"
    path.write_text('resolution = 2.0\nskipped = ["a"]\n')
    assert config.load_config(str(path)).skipped == ("a",)
    for bad in ("what = 1", "prune = 3.0", "in_flight = 0"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(str(path))
    assert config.choose_dimension(config.Config(), 1 << 30) == 384 and config.choose_dimension(config.Config(embedding_dim=8), 1) == 8
