import os
import subprocess
import sys

import corpus_pipeline
from llm_tables import FOLDER, of, tokenizer

from parley.llm import exact, language, packing, quality, simhash
from parley.llm.store import written

NAMES = ["language_id", "quality_classifier", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
PLACE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_stages_in_order_keep_the_columns(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    given, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = written(stage(spark, given, FOLDER), name)
        assert given.columns == docs.columns and given.dtypes == docs.dtypes
        counts.append(given.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_run_equals_the_stages_by_hand(spark, docs, labels):
    told = {r["doc_id"] for r in language.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    first = docs.filter(docs["doc_id"].isin(list(told)))
    good = {r["doc_id"] for r in quality.rate(first, labels).collect() if r["predicted"]}
    second = first.filter(first["doc_id"].isin(list(good)))
    kept = {r["doc_id"] for r in exact.exact_dedup(second).collect() if r["kept"]}
    third = second.filter(second["doc_id"].isin(list(kept)))
    one = {r["component_id"] for r in simhash.near_duplicates(third).collect()}
    fourth = third.filter(third["doc_id"].isin(list(one)))
    wanted = packing.pieces(fourth, tokenizer("word_bpe_49k.json"))
    assert of(corpus_pipeline.run(spark, FOLDER), *PLACE) == of(wanted, *PLACE)


def test_stages_take_edge_rows_and_empty_tables(spark, edge, none):
    for df in (edge, none):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, df, FOLDER)
            assert found.count() <= max(1, df.count()) or name == NAMES[-1]
            if name != NAMES[-1]:
                assert found.columns == df.columns


def test_entry_registers_every_operator():
    import __spark_entry__

    names = [n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")]
    assert names == [f"op{i}" for i in range(1, 14)] and "pipeline" in __spark_entry__.queries()


def test_entry_works_without_this_folder(tmp_path):
    """As after the folder, its tests and the pipeline are deleted."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('parley.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert len(names) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert 'pipeline' not in names and e.oracle_sql()\n"
    )
    root = os.path.dirname(corpus_pipeline.__file__)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
