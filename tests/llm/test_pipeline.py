"""The pipeline and the registration of the queries."""

import corpus_pipeline
import __spark_entry__ as entry
from spendlabel.llm import decontaminate, simhash, toxicity

from .helpers import CHECK, edge_rows, prose, table, with_clashes
from .test_rules_lines import brute_lines
from .test_substrings import brute_components, brute_print


def test_all_are_registered():
    names = list(entry.queries())
    assert [x for x in names if x == "pipeline"] and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "segmentation"]


def test_stages_against_brute_force(spark, tmp_path):
    line = prose(11, 12)
    rows = edge_rows()[:-1] + [(100 + i, f"{prose(40 + i, 70)}\n{line}", "en", "s") for i in range(8)]
    rows += [(200 + i, prose(60, 80) + f" end{i}", "en", "s") for i in range(3)]  # near copies
    rows += [(300, prose(70, 60) + " " + prose(71, 30) + " " + prose(72, 40), "en", "s")]  # leaks item 1
    rows += [(400 + i, prose(300 + i, 60) + " vile vile", "en", "s") for i in range(30)]
    rows += [(500 + i, prose(900 + i, 60), "en", "s") for i in range(60)]
    docs = table(spark, rows)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(400 + i, 1, 1) for i in range(30)] + [(500 + i, 1, 0) for i in range(60)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(71, 30))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def step(name, before):
        out = stage[name](spark, before, sf)
        assert out.columns == docs.columns
        return table_rows(out)

    def table_rows(df):
        return sorted((tuple(r)[:4] for r in df.collect()), key=repr)

    clean = step("toxicity", docs)
    gone = {r[0] for r in rows} - {r[0] for r in clean}
    assert {400 + i for i in range(30)} <= gone and not gone & {r[0] for r in rows if r[0] and not 400 <= r[0] < 500 and r[1]}
    lined = step("line_dedup", table(spark, clean))
    assert sorted((i, len((t or "").split("\n")) ) for i, t, *_ in lined if i) == sorted(
        (i, max(1, n - d)) for i, n, d, _ in brute_lines(clean) if i)
    single = step("near_dedup", table(spark, lined))
    group = brute_components([brute_print(t) for _, t, *_ in lined])
    least = {}
    for i, t, *_ in lined:
        if i is not None:
            g = group[brute_print(t)]
            least[g] = min(i, least.get(g, i))
    assert sorted(r[0] for r in single if r[0] is not None) == sorted(least.values())
    safe = step("decontamination", table(spark, single))
    assert {r[0] for r in single} - {r[0] for r in safe} == {300}
    coded = stage["segmentation"](spark, table(spark, safe), sf)
    assert coded.where("round_trip").count() == len(safe)
    assert corpus_pipeline.run(spark, sf).count() == len(safe)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    line = prose(11, 12)
    rows = edge_rows()[:-1] + [(100 + i, f"{prose(40 + i, 70)}\n{line}", "en", "s") for i in range(8)]
    rows += [(200 + i, prose(60, 80) + f" end{i}", "en", "s") for i in range(3)]
    docs = with_clashes(table(spark, rows))
    sf = str(tmp_path)
    spark.createDataFrame([(100, 1, 0), (101, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(71, 30))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), name)
        assert docs.columns == with_clashes(table(spark, [])).columns
        assert docs.where("n_lines = 'own n_lines' and kept_text = 'own kept_text' and n_rows = 'own n_rows' and "
                          "`dotted.name` = 'own dotted.name' and nested.`a b.c` = 1").count() == docs.count() > 10
    assert corpus_pipeline.encode(spark, docs, sf).count() == docs.count()


def test_whole_run_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{CHECK}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, CHECK).select("doc_id").collect()}
    tox = {r.doc_id for r in toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{CHECK}/labels.parquet")))
           .where("predicted = 1").collect()}
    leaks = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{CHECK}/benchmark.parquet")).collect()}
    copies = {r.doc_id for r in simhash.components(docs).where("component_id <> doc_id").collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not out & tox and not out & leaks
    assert len(every - tox - leaks - copies - out) <= 0.01 * len(every)  # line dedup may make more copies
