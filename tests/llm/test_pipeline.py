"""The pipeline's stages against plain versions, each on what the stage before kept."""
import corpus_pipeline
from cladeloom.llm.queries import VOCABULARY  # noqa: F401
from tests.llm import cases

TINY = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TINY)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns
            before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
            after = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
            kept[name] = before, after
        docs = out
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{TINY}/labels.parquet").where("toxic = 1").collect()}
    before, after = kept["toxicity"]
    assert len(before.keys() - after.keys() - toxic) <= 0.05 * len(before)
    before, after = kept["jaccard_join"]
    want = cases.jaccard_components(list(before.items()))
    assert set(after) == {i for i, (n, c) in want.items() if n == 0 or i == c}
    before, after = kept["suffix_dedup"]
    assert after == {i: raw.decode("utf-8", "ignore") for i, (raw, *_) in cases.kept_bytes(list(before.items())).items()}
    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    assert set(after) == {i for i, (_, hit, _) in cases.benchmark_hits(list(before.items()), items).items() if not hit}
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(after) and max(r["offset"] + r["length"] for r in pieces) <= 2048


def test_rest_imports_without_this_package(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still gives the other queries."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("cladeloom", "__spark_entry__.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"],
                          cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[1:] == ["False", "False"] and int(said.stdout.split()[0]) > 250, said.stderr
