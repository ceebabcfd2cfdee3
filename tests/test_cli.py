import json

from lodestone.plans.cli import main
from lodestone.sources import corpus


def test_cli(spark, tmp_path):
    import yaml

    for path, text in corpus.FILES.items():
        if path.startswith(("web/", "src/main")):
            (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / path).write_text(text)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/all.yaml").write_text(yaml.safe_dump({"rules": corpus.RULES}))
    out = [str(tmp_path / f"r{s}") for s in (".sarif", ".html", ".json", ".txt")]
    code = main([str(tmp_path / "in"), "--rules", str(tmp_path / "rules"), *(x for o in out for x in ("-o", o))], spark)
    assert code == 3
    assert json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["results"]
    assert "SQLI-100" in (tmp_path / "r.html").read_text() and "CRITICAL" in (tmp_path / "r.txt").read_text()
    assert spark.read.json(str(tmp_path / "r.json")).count() > 10
