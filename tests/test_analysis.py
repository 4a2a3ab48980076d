import numpy as np
import pytest

from kinfold.operators.sampler import RunLength
from kinfold.plans.analysis import Analysis, run


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three survey files of two villages."""
    rng = np.random.default_rng(2)
    folder = tmp_path_factory.mktemp("survey")
    ids = [f"p{k}" for k in range(60)]
    village = {p: str(k % 2) for k, p in enumerate(ids)}
    sex = [str(x) for x in rng.choice(["0", "1"], 58)] + ["NA", ""]
    (folder / "nodes.csv").write_text("\n".join(["villageId,i,female"] + [f"{village[p]},{p},{s}" for p, s in zip(ids, sex)]) + "\n")
    (folder / "cps.csv").write_text("\n".join(["villageId,i,villageTxt,hh"] + [f"{village[p]},{p},V{village[p]},h{k // 3}" for k, p in enumerate(ids)]) + "\n")
    links = {(i, j, t) for i in ids for t in ("lender", "friend", "family", "geo") for j in rng.choice(ids, 6) if village[j] == village[i]}
    (folder / "ties.csv").write_text("\n".join(["villageId,i,j,type,dist"] + [f"{village[i]},{i},{j},{t},1.5" for i, j, t in sorted(links)]) + "\n")
    return folder


def test_whole_run(spark, files, tmp_path):
    out = str(tmp_path / "out")
    a = run(spark, str(files / "nodes.csv"), str(files / "cps.csv"), str(files / "ties.csv"), out,
            RunLength(chains=4, draws=60, tune=60), strict=False)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    n = a.sample.count()
    assert 0 < n <= 58
    again = Analysis.saved(spark, out)
    assert again.run == RunLength(chains=4, draws=60, tune=60)
    assert again.sample.count() == n and again.dyads.count() == a.dyads.count() > 0
    assert again.stacked().count() == read("posterior").count()
    assert again.vectors.count() == 4 * 60 * (1 + 2 + 4) and again.hyper.count() == 3 * 4 * 60
    assert read("draws").groupBy("model").count().count() == 3
    assert read("summary").count() == (8 + 1 + 8 + 1) + (2 * 9 + 9) + (4 * 9 + 9)
    assert read("gate").count() == 3
    weights = [r["weight"] for r in read("comparison").collect()]
    assert sum(weights) == pytest.approx(1.0)
    assert read("elpd").where("model = 'Sex'").agg({"respondents": "sum"}).first()[0] == n
    p = read("predictive").groupBy("model", "category").agg({"y_observed_count": "sum"}).collect()
    assert {r[2] for r in p} == {n} and len(p) == 24
    assert read("figure_parallel").count() == 8 * (1 + 2 + 4)
    assert abs(sum(r["pmean"] for r in read("reported_means").collect()) - 1) < 1e-9


def test_unsummed_counts_stop_the_run(spark, files, tmp_path):
    text = (files / "ties.csv").read_text()
    line = next(x for x in text.splitlines() if ",lender," in x and x.split(",")[1] != x.split(",")[2])
    (tmp_path / "ties.csv").write_text(text + line + "\n")
    with pytest.raises(ValueError, match="dedupe"):
        Analysis(spark, str(files / "nodes.csv"), str(files / "cps.csv"), str(tmp_path / "ties.csv"))
    Analysis(spark, str(files / "nodes.csv"), str(files / "cps.csv"), str(tmp_path / "ties.csv"), dedupe=True)
