"""The entry points: every oracle has its query, and the place queries stand without the corpus folder."""

import __spark_entry__ as entry
from placewright import registry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "position", "place_id", "km", "radius_used"]


def test_without_the_corpus_folder(monkeypatch):
    monkeypatch.setattr(entry, "_corpus", lambda: None)
    assert set(entry.queries()) == set(registry.queries())


def test_a_broken_corpus_part_is_not_taken_for_a_missing_one(tmp_path):
    """With the corpus folders gone the rest stands; with one of its parts broken the error shows."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "placewright", tmp_path / "placewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    ask = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert ask().stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]
    (tmp_path / "placewright" / "llm").mkdir()  # what is left of a deleted folder
    assert ask().returncode == 0
    (tmp_path / "placewright" / "llm" / "__init__.py").write_text("")
    (tmp_path / "placewright" / "llm" / "registry.py").write_text("from placewright.llm import nothing_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert ask().returncode != 0
