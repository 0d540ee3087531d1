import subprocess
import sys
from pathlib import Path

import pytest

from tests import dump
from tomeforge import __main__ as cli

REPO = Path(__file__).resolve().parent.parent


def test_build_and_ask(spark, tmp_path, capsys):
    path, index, _ = dump.write(tmp_path)
    config = tmp_path / "c.toml"
    names = {k: str(tmp_path / k) for k in ("pages", "tpl", "templates", "anchors", "counts", "index")}
    config.write_text(
        f'templates = "{names["templates"]}"\n[data]\ndump = "{path}"\nindex = "{index}"\n[indices]\npages = "{names["pages"]}"\ntemplates = "{names["tpl"]}"\n'
        f'[anchors]\nanchors = "{names["anchors"]}"\nanchor_counts = "{names["counts"]}"\n[search_index]\nindex_dir = "{names["index"]}"\n'
    )
    for command in (["build"], ["build"], ["index"], ["anchors"]):  # the second build finds everything there
        cli.main(["--config", str(config), *command])
    assert "Template:Box" in "".join(r[0] for r in spark.read.text(names["templates"]).collect())
    assert spark.read.text(names["anchors"]).count() == 6
    capsys.readouterr()
    cli.main(["--config", str(config), "counts", "the tea"])
    assert set(capsys.readouterr().out.splitlines()) == {"the tea\tTea\t2", "the tea\tGreen Tea\t1"}
    cli.main(["--config", str(config), "prefix", "the tea\t"])
    assert capsys.readouterr().out.splitlines() == ["the tea\tGreen Tea\t1", "the tea\tTea\t2"]
    cli.main(["--config", str(config), "phrase", "of the"])
    assert capsys.readouterr().out.strip() == "1"
    cli.main(["--config", str(config), "link", "drink the tea"])
    assert capsys.readouterr().out.startswith("the tea\t")


def test_write_rows_and_extend_the_index(spark, tmp_path, capsys):
    path, index, _ = dump.write(tmp_path)
    config, store = tmp_path / "c.toml", str(tmp_path / "index")
    config.write_text(f'[data]\ndump = "{path}"\nindex = "{index}"\n[search_index]\nindex_dir = "{store}"\n')

    def lines(kind):
        cli.main(["--config", str(config), "write", kind, str(tmp_path / kind)])
        return [r[0] for r in spark.read.text(str(tmp_path / kind)).collect()]

    assert sorted(lines("redirects")) == ["Old Tea\tTea & more"] and "10\tTemplate:Box" in lines("titles")
    assert any('"title":"Tea"' in x for x in lines("pages")) and len(lines("categories")) == len(lines("categories-json")) == len(lines("anchors-json"))
    capsys.readouterr()
    cli.main(["--config", str(config), "extend"])
    built = int(capsys.readouterr().out)
    assert built == spark.read.parquet(store).count() > 0
    spark.read.parquet(store).where("id <> 11").write.parquet(store + "-part")
    config.write_text(config.read_text().replace(store, store + "-part"))
    cli.main(["--config", str(config), "extend"])
    assert int(capsys.readouterr().out) == 1 and spark.read.parquet(store + "-part").count() == built


def test_entry_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tomeforge.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_imports_the_corpus_operators():
    for file in (REPO / "tomeforge").rglob("*.py"):
        if "llm" not in file.relative_to(REPO).parts:
            assert "tomeforge.llm" not in file.read_text(), file


@pytest.mark.parametrize("module", ["bench", "__spark_entry__"])
def test_imports(module):
    __import__(module)
