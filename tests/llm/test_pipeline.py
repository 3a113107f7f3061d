"""The pipeline's stages, each against a plain version over its own input."""

import corpus_pipeline
from test_operators import plain_components, plain_counts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "quality rules":
            good = {d for d, r in before.items() if (c := plain_counts(r["text"]))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
            assert set(after) <= good and len(after) > 0.9 * len(good)
        if name == "line dedup":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "n-gram Jaccard join":
            assert set(after) == {c for _, c in plain_components([(d, r["text"]) for d, r in before.items()]).values()}
        if name == "benchmark decontamination":
            leaky = {d for d, r in before.items() if any(i in r["text"] for i in items)}
            assert leaky and set(before) - set(after) == leaky
        if name == "byte-level BPE":
            assert set(after) == set(before) and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in after.values())
        docs = out


def test_near_copies_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    data = [
        (1, a, "p"), (2, a + " end", "p"), (2, b, "p"),  # an id that clashes: one row a copy, the other clean
        (3, c, "q"), (3, c, "p"), (3, c, "p"), (4, c + " end", "p"),  # repeated rows
        (None, d, "p"), (None, d + " end", "p"), (None, d, "p"), (9, d, "p"),  # near copies without an id
        (None, " ".join(f"e{i}" for i in range(30)), "p"), (None, "", "p"), (5, None, "p"), (5, None, "p"),
    ]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in stage(spark, frame, SF).collect()), key=str)
    of_d = [r for r in got if r[1] and r[1].startswith("d0")]
    assert len(of_d) == 1 and of_d[0] in [(None, d, "p"), (None, d + " end", "p")]
    assert [r for r in got if r not in of_d] == sorted([data[0], data[2], (3, c, "p"), *data[11:]], key=str)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids", "n_tokens", "exact"]
