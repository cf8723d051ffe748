import corpus_pipeline as P
from helpers import EDGES, docs

from pageloom.llm import neardup, packing, quality, secrets
from pageloom.llm.common import written
from pageloom.llm.tokens import ByteBpe, default_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_order(spark):
    assert [n for n, _ in P.STAGES] == ["language ID", "quality rules", "near-duplicates", "secret scans", "packing"]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        before, df = df, written(stage(spark, df, SF), "stage")
        assert df.columns == P.COLUMNS and df.schema.simpleString() == before.schema.simpleString()


def test_run_equals_its_operators(spark):
    got = P.run(spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    named = P.identify_language(spark, raw, SF)
    good = written(quality.quality(named).where("kept").select(*P.COLUMNS), "good")
    kept = {r["doc_id"] for r in neardup.near_duplicates(good).where("kept").collect()}
    assert set(got.doc_id) == kept
    hit = {r["doc_id"] for r in secrets.op4_secret_scans(spark, SF).where("spans <> ''").select("doc_id").collect()}
    bpe = ByteBpe(default_path())
    tokens = got.groupby("doc_id").length.sum()
    for r in good.collect():
        if r["doc_id"] in kept - hit:
            assert tokens[r["doc_id"]] == len(bpe.ids(r["text"])) + 1
    assert packing.SEQUENCE >= got.groupby("sequence_id").length.sum().max()


def test_clean_labels_stay(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    counted = quality.quality(raw).where("not base_failed").join(clean, "doc_id")
    assert counted.where("kept").count() >= 0.99 * counted.count()
    named = P.identify_language(spark, raw, SF).join(clean, "doc_id").count()
    assert named >= 0.99 * raw.join(clean, "doc_id").count()


def test_edges(spark):
    df = docs(spark, [*EDGES, (50, "my password=abcdefghijklmnop end")])
    assert P.drop_near_duplicates(spark, df, SF).where("doc_id = 5").count() == 1
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight"
    rows = P.drop_near_duplicates(spark, docs(spark, [(5, a), (5, b), (6, a), (None, a), (None, b + " nine"), (None, b + " nine"), (8, None), (8, "")]), SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows.collect()) == sorted([(5, a), (5, b), (0, b + " nine"), (8, ""), (8, "")])
    out = {r["doc_id"]: r for r in P.redact_secrets(spark, df, SF).collect()}
    assert out[50]["text"] == "my [REDACTED] end" and out[50]["n_chars"] == len(out[50]["text"]) and out[1]["text"] is None
    none = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_every_stage_bears_odd_rows_and_clashing_columns(spark):
    prose = "the quick brown fox and that lazy dog of the house went to see it with them because there was some time left for it. " * 8
    rows = [*EDGES, (None, None), (60, prose), (61, prose + "More."), (62, "long " + "wordy " * 50_000)]
    df = docs(spark, rows, "lang_pred", "score", "kept", "n_words", "node", "digest", "component", "spans", "blob", "_row", "_id", "sequence_id", "copy")
    for name, stage in P.STAGES:
        out = stage(spark, df, SF)
        got = out.collect()
        if name != "packing":
            assert out.columns == P.COLUMNS
            assert {r["doc_id"] for r in got} <= {i for i, _ in rows}
        else:
            assert {r["doc_id"] for r in got} == {i for i, _ in rows}
        if name in ("near-duplicates", "secret scans"):
            assert 62 in {r["doc_id"] for r in got}
