import pytest

from kinrank.operators import cochange as co
from kinrank import session
from kinrank.session import shared_dir, written
from kinrank.sources import loaders as LD

LOG = ("__COMMIT__\r\nlib/a.rs\r\n\tlib/b.rs \r\n\r\n__COMMIT__\r\ndocs/__COMMIT__notes.md\r\n__COMMIT__\r\n\r\n"
       " __COMMIT__x\n__COMMIT__\nlib/c.rs\n" + "".join(f"big/f{i}.rs\n" for i in range(300)))


def parsed(spark, path):
    groups = {}
    for r in LD.parse_changelog(spark, path).orderBy("line_no").collect():
        groups.setdefault(r.group_id, []).append(r.item)
    return [groups[k] for k in sorted(groups)]


def test_changelog_by_whole_lines_in_any_split(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(LOG.encode())
    want = [["lib/a.rs", "lib/b.rs"], ["docs/__COMMIT__notes.md"], ["__COMMIT__x"],
            ["lib/c.rs", *(f"big/f{i}.rs" for i in range(300))]]
    assert parsed(spark, str(tmp_path)) == want
    first = LD.parse_changelog(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        assert parsed(spark, str(tmp_path)) == want
        assert sorted(LD.parse_changelog(spark, str(tmp_path)).collect()) == sorted(first)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    newest = co.limit_history(LD.parse_changelog(spark, str(tmp_path)), 2)
    assert {r.item for r in newest.collect()} == {"lib/a.rs", "lib/b.rs", "docs/__COMMIT__notes.md"}


def test_lines_before_the_first_marker_are_a_commit(spark, tmp_path):
    (tmp_path / "log.txt").write_text("early.c\n__COMMIT__\nlate.c\n")
    assert parsed(spark, str(tmp_path)) == [["early.c"], ["late.c"]]


def test_read_files_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "b.txt").write_text("é")
    got = {r.item_id: r.content for r in LD.read_files(spark, str(tmp_path)).select("item_id", "content").collect()}
    assert got["b.txt"] == "é" and got["sub/a.txt"].startswith("ok \ufffd")


def test_hidden_and_flat_trees(spark, tmp_path, monkeypatch):
    from kinrank.sources import files
    monkeypatch.setattr(files, "FLAT", 7)
    names = ["__init__.py", "_form.php", ".env", ".git/config", "a/b/c/d/_deep/.x", "a/plain.txt", *(f"flat/f{i}" for i in range(30))]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "nowhere").symlink_to(tmp_path / "missing")
    (tmp_path / "empty").mkdir()
    for pieces in (1, 3, 64):
        got = files.read_tree(spark, f"file://{tmp_path}", pieces).collect()
        assert sorted(r.path for r in got) == sorted(names) and all(r.content == r.path and r.mtime for r in got)


def test_rules_from_a_table(spark, monkeypatch):
    df = spark.createDataFrame([(f"src/a{i}.ts",) for i in range(40)], "path string")
    rules = spark.createDataFrame([(f"a{i}[.]",) for i in range(0, 40, 2)] + [(None,), ("a0[.]",)], "pattern string")
    want = sorted(f"src/a{i}.ts" for i in range(1, 40, 2))
    assert sorted(r.path for r in LD.exclude_by(df, rules).collect()) == want
    monkeypatch.setattr(LD, "RULE_CHARS", 30)
    assert sorted(r.path for r in LD.exclude_by(df, rules).collect()) == want
    assert LD.exclude_by(df, rules.where("false")).count() == 40


def test_items_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("./x/a.py", "t"), ("/r/b.py", None)], "path string, content string")
    LD.write_ranked(df, str(tmp_path / "items"))
    got = sorted((r.item_id, r.path) for r in LD.read_items(spark, str(tmp_path / "items"), "/r").collect())
    assert got == [("b.py", "b.py"), ("x/a.py", "x/a.py")]


def test_relativize_and_exclude(spark):
    df = spark.createDataFrame([("/repo/src/a.ts",), ("./lib/b.ts",), ("/repo/vendor/x.js",), ("a|b",)], "path string")
    rel = LD.relativize(df, "/repo")
    assert sorted(r.path for r in LD.exclude(rel, ["^vendor/", r"\|"]).collect()) == ["lib/b.ts", "src/a.ts"]
    assert LD.exclude(rel, []).count() == 4
    assert LD.exclude(rel, ["^vendor/", r"\|", "^lib"], fold=1).count() == 1


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        shared_dir(Session())


def test_intermediate_tables_can_be_removed(spark, monkeypatch):
    import os
    monkeypatch.setattr(session, "_FOLDERS", [])
    df = written(spark.range(5).where("id > 9"))
    assert df.count() == 0 and df.columns == ["id"]
    folder = session._FOLDERS[0].removeprefix("file://")
    assert os.path.isdir(folder)
    session.remove_written(spark)
    assert not os.path.exists(folder) and not session._FOLDERS


def test_texts_of_parts_are_derived_in_many_tasks(spark, tmp_path):
    from kinrank.sources import tables as T
    rows = [(i, f"red ring{i % 3}", "SMALL", "Brand#1", i % 50) for i in range(90)] + [(7, None, None, None, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet")
    items = T.code_items(spark, str(tmp_path))
    per_task = items.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in per_task) >= 4 and sum(per_task) == 91
