import json
import os
import random

from lexivane import experiments as X
from lexivane.cli import main
from lexivane.sources.records import read_run, read_toml


def test_grid_resume_and_best(spark, tmp_path, capsys):
    rng = random.Random(1)
    docs = [{"id": i, "vector": {f"t{t}": rng.randint(1, 64) / 8 for t in rng.sample(range(15), 5)}} for i in range(60)]
    for name, rows in (("docs", docs), ("queries", docs[:6])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "qrels.tsv").write_text("".join(f"{i}\t0\t{i}\t1\n" for i in range(6)))
    data = {"documents": str(tmp_path / "docs.jsonl"), "queries": str(tmp_path / "queries.jsonl"), "qrels": str(tmp_path / "qrels.tsv")}
    indexing = {"pruning": ["fixed"], "n_postings": 100, "blocking": "fixed", "block_size": 2, "summary_energy": 1.0, "value_type": "f32"}
    config = {"data": data, "indexing": indexing, "query": {"all": {"k": 5, "query_cut": 10, "heap_factor": 0.0}, "one": {"k": 5, "query_cut": 1, "heap_factor": 1.0}}}
    out = str(tmp_path / "grid")
    reports = {r.subsection: r for r in X.run_grid_search(spark, config, out).collect()}
    assert reports["all"].recall == 1.0 and 0 < reports["one"].recall <= 1.0
    first = os.stat(f"{out}/{os.listdir(out)[0]}").st_mtime_ns
    again = X.run_grid_search(spark, config, out)
    assert os.stat(f"{out}/{os.listdir(out)[0]}").st_mtime_ns == first
    paths = X.write_best(again, config, str(tmp_path / "best"))
    assert len(paths) >= 10 and read_toml(paths[0])["indexing"]["n_postings"] == 100
    assert "failed" not in capsys.readouterr().out
    # the command line gives the same hits
    main(["build", "--input", data["documents"], "--output", str(tmp_path / "x"), "--pruning", "fixed", "--blocking", "fixed", "--block-size", "1", "--value-type", "f32"])
    main(["search", "--index", str(tmp_path / "x.index"), "--queries", data["queries"], "--output", str(tmp_path / "run"), "-k", "5", "--heap-factor", "0"])
    run = read_run(spark, str(tmp_path / "run")).where("rank_no = 1").collect()
    assert "6 queries" in capsys.readouterr().out and len(run) == 6
